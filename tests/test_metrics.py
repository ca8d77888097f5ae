import math

import pytest
from pyspark.sql import functions as F

from answerloom.operators import metrics as M


def _preds(spark, pairs, source="s", column="ai_x"):
    rows = [(i, column, source, y, 0.0, 1.0 if p else -1.0) for i, (y, p) in enumerate(pairs)]
    schema = "example_id long, ai_column string, source string, label int, logit_human double, logit_ai double"
    return M.with_scores(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("pairs, expected", [
    ([(1, 1), (0, 0)], (1.0, 1.0, 1.0, 1.0, 1.0)),
    ([(1, 0), (0, 1)], (0.0, 0.0, 0.0, 0.0, 0.0)),
    ([(0, 0), (0, 0)], (1.0, 1.0, 0.0, 0.0, 0.0)),
    ([(1, 0), (1, 1)], (0.5, 0.5, 1.0, 0.5, 2 / 3)),
    ([(1, 1), (0, 1), (0, 0), (0, 0)], (0.75, (1 + 2 / 3) / 2, 0.5, 1.0, 2 / 3)),
])
def test_binary_metrics(spark, pairs, expected):
    row = M.binary_metrics(_preds(spark, pairs)).first()
    got = (row.accuracy, row.balanced_accuracy, row.precision, row.recall, row.f1)
    assert got == pytest.approx(expected) and row.n == len(pairs)


def test_empty_predictions(spark):
    none = _preds(spark, [(1, 1)]).where("false")
    assert M.source_metrics(none).collect() == []


def test_single_class_source(spark):
    row = M.source_metrics(_preds(spark, [(0, 0), (0, 1)], "  ")).first()
    assert row.source == "unknown" and row.ai_accuracy is None and row.ai_n == 0
    assert row.human_accuracy == row.balanced_accuracy == 0.5
    assert row.macro_f1 == pytest.approx((2 / 3 + 0) / 2)
    assert (row.predicted_human_n, row.predicted_ai_n) == (1, 1)


def test_tie_goes_to_human_and_loss_is_stable(spark):
    schema = "label int, logit_human double, logit_ai double, ai_column string"
    df = spark.createDataFrame([(1, 0.5, 0.5, "a"), (0, 900.0, -900.0, "b"), (1, 900.0, -900.0, "c")], schema)
    scored = {r.ai_column: r for r in M.with_scores(df).collect()}
    assert scored["a"].prediction == 0 and scored["a"].prob_human == 0.5
    assert scored["c"].confidence == 1.0
    loss = {r.ai_column: r.loss for r in M.eval_loss(df, ["ai_column"]).collect()}
    assert loss["a"] == pytest.approx(math.log(2)) and loss["b"] == 0.0 and loss["c"] == 1800.0


def test_matrix_report_and_sums(spark):
    preds = _preds(spark, [(1, 1), (0, 1), (0, 0), (0, 0)])
    cells = {(r.label, r.prediction): r.n for r in M.confusion_matrix(preds).collect()}
    assert cells == {("human", "human"): 2, ("human", "ai"): 1, ("ai", "human"): 0, ("ai", "ai"): 1}
    report = {r.entry: r for r in M.classification_report(preds).collect()}
    assert report["human"].recall == pytest.approx(2 / 3) and report["human"].support == 3
    assert report["macro avg"].precision == pytest.approx((1 + 0.5) / 2)
    assert report["weighted avg"].recall == pytest.approx((2 / 3 * 3 + 1) / 4)
    assert report["accuracy"].f1_score == 0.75 and report["accuracy"].support == 4


def test_source_counts_sum_to_overall(spark):
    preds = _preds(spark, [(1, 1), (0, 1)], "a").union(_preds(spark, [(0, 0), (1, 0), (1, 1)], "b"))
    summed = M.eval_metrics_of(M.summed_counts(M.source_counts(preds))).first().asDict()
    direct = M.column_metrics(preds).first().asDict()
    assert summed == pytest.approx(direct)
    overall = M.source_and_overall_metrics(preds).where("source is null").first()
    assert overall.n == 5 and overall.accuracy == pytest.approx(direct["accuracy"])


def test_sweep_and_charts(spark):
    preds = _preds(spark, [(1, 1), (0, 0)]).withColumn("train_rows", F.lit(10).cast("long"))
    sweep = M.sweep_metrics(preds, [10, 20, 10])
    got = {r.train_rows: (r.size_key, r.status, r.eval_accuracy) for r in sweep.collect()}
    assert got == {10: ("train_rows_10", "completed", 1.0), 20: ("train_rows_20", "skipped", None)}
    assert {(r.train_rows, r.metric, r.value) for r in M.size_chart(sweep).collect()} == {(10, "accuracy", 1.0), (10, "f1", 1.0)}
    chart = {r.metric: r.value for r in M.source_chart(M.source_metrics(preds)).collect()}
    assert chart == {"accuracy": 1.0, "ai_precision": 1.0, "ai_recall": 1.0, "ai_f1": 1.0}


def test_bad_rows_follow_the_order(spark):
    preds = _preds(spark, [(1, 0)] * 5 + [(0, 0)]).withColumns({"eval_order": 10 - F.col("example_id"), "answer": F.lit("  long answer")})
    rows = M.bad_rows(preds, 2, 4).collect()
    assert sorted(r.example_id for r in rows) == [3, 4]
    assert {(r.label, r.prediction, r.answer) for r in rows} == {("ai", "human", "long")}
    assert M.prediction_rows(preds).count() == 6
