import hashlib

import pytest
from pyspark.sql import functions as F

from answerloom.operators import sampling as S
from answerloom.operators.corpus import freeze_human, with_human_answer, with_origin

N = 500


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(N).select(
        F.when(F.col("id") % 4 == 0, "eval").otherwise("train").alias("split"), F.col("id").alias("row_id")
    )


def _expected(seed=1, split=None):
    keys = [(("eval" if i % 4 == 0 else "train"), i) for i in range(N)]
    keys = [k for k in keys if split is None or k[0] == split]
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k[0]}:{k[1]}".encode()).hexdigest(), *k))


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_positions_are_a_dense_permutation(rows, digits):
    got = {(r.split, r.row_id): r.position for r in S.seeded_positions(rows, 1, ["split", "row_id"], digits=digits).collect()}
    assert got == {k: i for i, k in enumerate(_expected())}


def test_positions_per_group_and_limit(rows):
    got = S.seeded_positions(rows, 1, ["split", "row_id"], ["split"], below=7).collect()
    for split in ("train", "eval"):
        mine = {r.row_id: r.position for r in got if r.split == split}
        assert mine == {k[1]: i for i, k in enumerate(_expected(split=split)[:7])}


def test_counting_numbers_only_some_rows(rows):
    odd = F.col("row_id") % 3 == 0
    got = S.seeded_positions(rows, 1, ["split", "row_id"], ["split"], counting=odd, total="n").collect()
    for split in ("train", "eval"):
        wanted = [k for k in _expected(split=split) if k[1] % 3 == 0]
        assert {r.row_id: r.position for r in got if r.split == split and r.position is not None} == {
            k[1]: i for i, k in enumerate(wanted)
        }
        assert {r.n for r in got if r.split == split} == {len(wanted)}
    assert len(got) == N


@pytest.mark.parametrize("shuffles, parts", [(1, 1), (4, 7), (16, 3)])
def test_same_sample_under_any_partitioning(spark, rows, shuffles, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        shuffled = rows.repartition(parts).orderBy(F.rand(parts))
        cut = S.train_eval_split(shuffled, 100, 50, 1)
        got = {(r.split, r.row_id): r.origin_index for r in cut.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = [k[1] for k in _expected()]
    assert got == {("train", i): order[i] for i in range(100)} | {("eval", i): order[100 + i] for i in range(50)}


def test_train_eval_split_checks_sizes(rows):
    for sizes in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            S.train_eval_split(rows, *sizes, 1)
    with pytest.raises(ValueError, match="Requested 501 rows but only 500"):
        S.train_eval_split(rows, 500, 1, 1)


def test_origin_survives_the_cut(rows):
    cut = S.train_eval_split(with_origin(rows), 400, 100, 3).collect()
    assert {(r.origin_split, r.origin_index) for r in cut} == {("eval" if i % 4 == 0 else "train", i) for i in range(N)}


def test_size_subsets_are_nested(rows):
    got = S.size_subsets(rows, [10, 40, 25], 5).collect()
    by_size = {s: {r.row_id for r in got if r.train_rows == s} for s in (10, 25, 40)}
    assert [len(by_size[s]) for s in (10, 25, 40)] == [10, 25, 40]
    assert by_size[10] < by_size[25] < by_size[40]


def test_sweep_sizes():
    assert S.sweep_sizes([5, 3, 5], 10) == [5, 3]
    for bad in ([], [0], [11]):
        with pytest.raises(ValueError):
            S.sweep_sizes(bad, 10)


def test_subsample_and_sample(rows):
    examples = rows.withColumns({"example_id": F.col("row_id"), "ai_column": F.lit("ai_x")})
    got = S.subsample(examples, 20, 2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 20, "eval": 20}
    assert S.subsample(examples, None, 2) is examples
    assert S.subsample(examples, 10_000, 2).count() == N
    with pytest.raises(ValueError):
        S.subsample(examples, 0, 2)
    small = {r.row_id for r in S.sample_rows(rows, 30, 4).collect()}
    assert small == {r.row_id for r in S.sample_rows(rows.repartition(7), 30, 4).collect()} and len(small) == 30
    assert S.sample_rows(rows, N + 1, 4).count() == N


def test_first_n_per_group(rows):
    got = S.first_n(rows, 3, ["row_id"], ["split"]).collect()
    assert {(r.split, r.row_id) for r in got} == {("eval", 0), ("eval", 4), ("eval", 8), ("train", 1), ("train", 2), ("train", 3)}


def test_frozen_answer_and_fallback(spark):
    data = [(0, ["", "a", " b "], None), (1, [" "], "kept"), (2, None, "  "), (3, ["x", "y", "z"], " ")]
    df = spark.createDataFrame(data, "row_id long, human_answers array<string>, selected_human_answer string")
    df = df.withColumn("split", F.lit("train")).withColumn("question", F.lit("q"))
    effective = {r.row_id: r.human_answer for r in with_human_answer(df, 9).collect()}
    frozen = {r.row_id: (r.selected_human_answer, r.selected_human_answer_index) for r in freeze_human(df, 9).collect()}
    assert frozen[1] == ("", -1) and frozen[2] == ("", -1)
    assert effective[1] == "kept" and effective[2] == ""
    assert frozen[0][0] == ["a", "b"][frozen[0][1]] == effective[0]
    assert frozen[3][0] == ["x", "y", "z"][frozen[3][1]] == effective[3]
