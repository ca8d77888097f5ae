import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.operators import lengths as L


@pytest.fixture(scope="module")
def lengths():
    rnd = random.Random(3)
    return {"a": [rnd.randrange(0, 200) for _ in range(301)], "b": [1, 1, 2, 500], "zero": [0, 0]}


@pytest.fixture(scope="module")
def freq(spark, lengths):
    rows = [(c, n) for c, values in lengths.items() for n in values]
    return spark.createDataFrame(rows, "answer_column string, length int").groupBy("answer_column", "length").agg(F.count(F.lit(1)).alias("n")).cache()


def test_stats(freq, lengths):
    got = {r.answer_column: r for r in L.length_stats(freq, [*lengths, "none"]).collect()}
    for column, values in lengths.items():
        r = got[column]
        assert (r.n, r["min"], r["max"]) == (len(values), min(values), max(values))
        wanted = [np.mean(values), np.median(values), *[np.percentile(values, p) for p in (90, 95, 99)]]
        assert [r["mean"], r["median"], r.p90, r.p95, r.p99] == pytest.approx(wanted)
    assert got["none"].n == 0 and got["none"]["mean"] is None


def test_cap(freq, lengths):
    pooled = [n for values in lengths.values() for n in values]
    assert L.length_cap(freq).first().cap == int(np.ceil(np.percentile(pooled, 99.5)))
    assert L.length_cap(freq, 7).first().cap == 7
    assert L.length_cap(freq, percentile_cap=100).first().cap is None
    for bad in ({"max_length": 0}, {"percentile_cap": 0}):
        with pytest.raises(ValueError):
            L.length_cap(freq, **bad)


@pytest.mark.parametrize("cap, bins", [(None, 80), (150, 80), (150, 7), (1, 3)])
def test_histogram(freq, lengths, cap, bins):
    limit = L.length_cap(freq, cap) if cap else L.length_cap(freq, percentile_cap=100)
    rows = L.length_histogram(freq, limit, bins).collect()
    for column, values in lengths.items():
        shown = np.array([n for n in values if cap is None or n <= cap], dtype=float)
        mine = sorted((r for r in rows if r.answer_column == column), key=lambda r: r.bin)
        if not len(shown):
            assert not mine
            continue
        upper = max(1, cap if cap is not None else int(shown.max()))
        density, edges = np.histogram(shown, bins=bins, range=(0, upper), density=True)
        assert [r.density for r in mine] == pytest.approx(list(density))
        assert [r.center for r in mine] == pytest.approx(list((edges[:-1] + edges[1:]) / 2))


def test_units(spark):
    df = spark.createDataFrame([(["a b", " "], "x-y z"), (None, None)], "human_answers array<string>, ai_m string")
    count = lambda unit, **k: {(r.answer_column, r.length): r.n for r in L.length_frequencies(df, ["human_answers", "ai_m"], unit, **k).collect()}
    assert count("words") == {("human_answers", 2): 1, ("ai_m", 3): 1}
    assert count("chars") == {("human_answers", 3): 1, ("ai_m", 5): 1}

    @F.pandas_udf("int")
    def halves(texts):
        return texts.str.len() // 2

    assert count("tokens", token_length=halves) == {("human_answers", 1): 1, ("ai_m", 2): 1}
    for bad in ("tokens", "lines"):
        with pytest.raises(ValueError):
            L.length_frequencies(df, ["ai_m"], bad)


def test_sketches_merge_over_runs(spark):
    values = [i * i % 997 for i in range(6000)]
    df = spark.createDataFrame([(i, "x " * v) for i, v in enumerate(values) if v], "row_id long, ai_a string").repartition(6)
    parts = [L.length_sketches(df.where(F.col("row_id") % 3 == r), ["ai_a"], size=256) for r in range(3)]
    sketches = parts[0].unionByName(parts[1]).unionByName(parts[2])
    merged = L.merged_sketches(sketches).first()
    real = sorted(v for v in values if v)
    assert (merged.n, merged.min, merged.max) == (len(real), real[0], real[-1]) and len(merged.sketch) < 20_000
    stats = L.sketched_stats(sketches).first()
    for share, value in ((0.5, stats.median), (0.9, stats.p90), (0.99, stats.p99), (0.995, L.sketched_cap(sketches).first().cap)):
        below, upto = (sum(v < value for v in real) / len(real), sum(v <= value for v in real) / len(real))
        assert below <= share + 2 * L.rank_error(256) and upto >= share - 2 * L.rank_error(256)
    assert L.rank_error() < 0.001
