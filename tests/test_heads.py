import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.operators import heads as H
from answerloom.operators import metrics as M
from answerloom.operators.learning import TrainParams

PARAMS = TrainParams(features=1 << 8, max_iter=6, held_out_share=0.3)


def _data(spark, n=120):
    """Tokenized examples of two columns whose label a word tells, with noise, and the place of each row."""
    rows = []
    for i in range(n):
        for column in ("ai_a", "ai_b"):
            for label in (0, 1):
                told = label if (i * 7 + label) % 9 else 1 - label
                words = [f"w{(i * 31 + j) % 40}" for j in range(5)] + [f"{column}{told}"]
                rows.append(("train" if i % 4 else "eval", i, column, label, words, i * 37 % n))
    schema = "split string, row_id long, ai_column string, label int, tokens array<string>, place long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def data(spark):
    return _data(spark).cache()


def test_heads_learn_their_own_columns(spark, data):
    heads = H.fit_heads(data.where("split = 'train'"), ["ai_a", "ai_b"], PARAMS)
    assert heads.columns == ("ai_a", "ai_b") and all(1 <= e <= 6 for e in heads.epochs)
    scored = H.score_heads(heads, data.where("split = 'eval'"))
    by = {(r.model_column, r.eval_column): r.accuracy for r in M.binary_metrics(scored, ["model_column", "eval_column"]).collect()}
    assert len(by) == 4 and by["ai_a", "ai_a"] > 0.8 and by["ai_b", "ai_b"] > 0.8
    own = H.score_heads(heads, data.where("split = 'eval'"), own_column_only=True)
    assert own.count() == data.where("split = 'eval'").count() and own.where("model_column <> ai_column").count() == 0


def test_gradient_is_that_of_the_loss(spark, data):
    features = H.featured(data, ["ai_a", "ai_b"], PARAMS, "place").cache()
    idf = H.inverse_frequencies(features, PARAMS.features)
    r = np.random.default_rng(0)
    points = r.normal(size=(4, PARAMS.features + 1))
    loss, slope, counts = H.evaluate_points(features, idf, points, 2, [None, 60], True)
    moved = r.normal(size=points.shape) * 1e-4
    up = H.evaluate_points(features, idf, points + moved, 2, [None, 60], True)[0]
    assert np.allclose(up - loss, (slope * moved).sum(axis=1), rtol=0.02, atol=1e-8)
    # plain Python over the same rows
    for head in range(4):
        column, limit = ("ai_a", "ai_b")[head // 2], (None, 60)[head % 2]
        total, n = 0.0, 0
        for row in features.where(F.col("head") == head // 2).collect():
            value = {w: c * idf[w] for w, c in zip(row.words, row.counts)}
            size = sum(v * v for v in value.values()) ** 0.5
            margin = sum(v / size * points[head][w] for w, v in value.items()) + points[head][-1]
            if not row.held and (limit is None or row.place < limit):
                total += np.log1p(np.exp(-margin if row.label else margin))
                n += 1
        assert loss[head] == pytest.approx(total / n), column
    assert counts[0].sum() > 0


def test_nested_limits_are_heads_of_their_own(spark, data):
    params = TrainParams(features=1 << 8, max_iter=4, held_out_share=0.0)
    train = data.where("split = 'train' and ai_column = 'ai_a'")
    both = H.fit_heads(train, ["ai_a"], params, [30, 120], "place")
    assert both.limits == (30, 120) and both.held_out_f1 == (None, None) and all(1 <= e <= 4 for e in both.epochs)
    tables = H.featured(train, ["ai_a"], params, "place")
    idf = H.inverse_frequencies(tables, params.features)
    own = H.evaluate_points(tables.where("place < 30"), idf, both.weights[:1], 1, [None], False)
    among = H.evaluate_points(tables, idf, both.weights, 2, [30, 120], False)
    assert own[0][0] == pytest.approx(among[0][0]) and np.allclose(own[1][0], among[1][0])
    assert not np.allclose(both.weights[0], both.weights[1])


def test_best_setting_and_epoch_by_held_out_f1(spark, data):
    params = TrainParams(features=1 << 8, max_iter=5, held_out_share=0.3, reg_params=(1000.0, 0.001))
    heads = H.fit_heads(data.where("split = 'train'"), ["ai_a"], params)
    assert heads.reg_params[0] in params.reg_params and 0 < heads.held_out_f1[0] <= 1
    way = H._Descent(2)
    way.told(1.0, np.array([1.0, 0.0]), 0.1)
    for value, f1 in ((0.9, 0.7), (0.8, 0.9), (0.7, 0.8)):
        way.told(value, np.array([1.0, 0.0]), f1)
    assert way.best[:2] == (0.9, 2)
    way.told(5.0, np.array([1.0, 0.0]), 1.0)  # no step down: tried again nearer
    assert way.best[:2] == (0.9, 2) and way.halved == 1


def test_saved_heads_score_alike(spark, data, tmp_path):
    heads = H.fit_heads(data.where("split = 'train'"), ["ai_a", "ai_b"], PARAMS)
    path = str(tmp_path / "model")
    H.save_head(spark, heads.only(1), path)
    assert H.is_head(spark, path) and not H.is_head(spark, str(tmp_path))
    back = H.load_head(spark, path)
    assert back.columns == ("ai_b",) and back.epochs == heads.epochs[1:]
    tests = data.where("split = 'eval'")
    one = {(r.row_id, r.label, r.ai_column): r.logit_ai for r in H.score_heads(heads.only(1), tests).collect()}
    two = {(r.row_id, r.label, r.ai_column): r.logit_ai for r in H.score_heads(back, tests).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    with pytest.raises(ValueError):
        H.save_head(spark, heads, path)


def test_no_rows(spark, data):
    heads = H.fit_heads(data.limit(0), ["ai_a"], PARAMS)
    assert np.isfinite(heads.weights).all()
    assert H.score_heads(heads, data.limit(0)).count() == 0
