"""Suffix-array dedup, substring dedup and the n-gram join against brute force."""

import hashlib
import os
import random
import sys

import pyarrow as pa
import pytest
import zstandard

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
from fixtures import copies, frame, odd_documents, random_rows

from answerloom.llm import ngram_join, repeats, substring_dedup, suffix_dedup
from answerloom.llm.components import connected_components
from answerloom.session import checkpoint_dir, stage_buckets, unstage


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(params=[repeats.CROWD, 2], ids=["in place", "by windows"])
def crowd(request, monkeypatch):
    """Contested runs compared in place, and sent window by window."""
    monkeypatch.setattr(repeats, "CROWD", request.param)


def test_suffix_dedup_equals_brute_force(spark, crowd):
    rows = random_rows()
    assert by_id(suffix_dedup.suffix_dedup_digest(frame(spark, rows))) == brute.byte_dedup(rows)


def test_substring_dedup_equals_brute_force(spark, crowd):
    rows = random_rows(seed=8)
    assert by_id(substring_dedup.substring_dedup_digest(frame(spark, rows))) == brute.word_dedup(rows)


@pytest.mark.parametrize("shingle, percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, shingle, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 4)  # leaves that are compared pair by pair
    rows = copies()
    got = by_id(ngram_join.join_digest(ngram_join.near_duplicates(frame(spark, rows), shingle, percent)))
    assert got == brute.jaccard_groups(rows, shingle, percent)


def test_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert by_id(suffix_dedup.suffix_dedup_digest(docs)) == brute.byte_dedup(rows)
    assert by_id(substring_dedup.substring_dedup_digest(docs)) == brute.word_dedup(rows)
    assert by_id(ngram_join.join_digest(ngram_join.near_duplicates(docs))) == brute.jaccard_groups(rows)


def test_texts_that_stay(spark):
    long = "an old passage of text that is long enough to count, with numbers 1 2 3 4 5 6 7 8 9 10 and more of them"
    df = frame(spark, [(1, f"start {long} end"), (2, f"other {long} tail"), (3, long)], 1)
    out = {r["id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert bytes(out[1]["kept"]).decode() == f"start {long} end" and out[1]["spans"] == []
    assert bytes(out[2]["kept"]).decode() == "othertail"[:5] + "tail" and out[3]["n_removed"] == len(long)
    assert out[2]["kept_sha256"] == hashlib.sha256(bytes(out[2]["kept"])).hexdigest()
    rows = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert set(rows) == {1, 2}
    words = {r["id"]: r for r in substring_dedup.remove_repeated_words(df).collect()}
    assert words[2]["kept"] == "other tail" and words[3]["kept"] == ""


def test_odd_rows(spark):
    docs = odd_documents(spark)
    for out in (suffix_dedup.suffix_dedup_digest(docs), substring_dedup.substring_dedup_digest(docs)):
        rows = {r["doc_id"]: r for r in out.collect()}
        assert out.count() == 9 and rows[2]["n_removed"] == 0 and rows[1]["n_removed"] == 0
        assert rows[None]["n_removed"] == 0 or rows[None]["n_removed"] < rows[4]["n_removed"]
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.schema["rest"].dataType == docs.schema["rest"].dataType
    groups = ngram_join.near_duplicates(docs)
    rows = {r["doc_id"]: r for r in ngram_join.join_digest(groups).collect()}
    assert rows[5]["component_id"] is None and rows[1]["component_id"] == 1 and rows[2]["n_shingles"] == 0
    kept = ngram_join.one_of_each(docs, groups)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} >= {None, 1, 2, 3, 6, 7}


def test_repeated_rows_and_rows_without_id_in_two_partitions(spark, crowd):
    words = [f"{a}{i}" for i in range(60) for a in "pqrs"]
    once, other, third, shared = (" ".join(words[i : i + 50]) for i in (0, 50, 100, 150))
    rows = [(1, once), (None, other), (None, third), (2, shared), (3, f"x {shared}"), (4, f"{third} y")]
    half = frame(spark, rows, 1)
    for docs in (half.union(half), half.unionByName(half).coalesce(1)):
        for dedup in (suffix_dedup.remove_repeats, substring_dedup.remove_repeated_words):
            left = [(r["id"], bytes(r["kept"]).decode() if dedup is suffix_dedup.remove_repeats else r["kept"]) for r in dedup(docs).collect()]
            assert sorted((i or 0, t.strip()) for i, t in left) == sorted([(1, once), (0, other), (0, third), (2, shared), (3, "x"), (4, "y")] * 2)
        rest = [r["text"] for r in suffix_dedup.without_repeats(docs).where("doc_id is null or doc_id = 1").collect()]
        assert sorted(rest) == sorted([once, other, third] * 2)


def test_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    assert suffix_dedup.suffix_dedup_digest(docs).count() == 0
    assert substring_dedup.substring_dedup_digest(docs).count() == 0
    assert ngram_join.near_duplicates(docs).count() == 0


def test_components(spark):
    links = [(9, 8), (8, 7), (7, 6), (1, 2), (3, 2), (20, 21), (21, 20), (5, 5), (6, 30), (30, 31)]
    out = by_id(connected_components(spark.createDataFrame(links, "a long, b long")))
    full = {**{6: (6,), 1: (1,), 20: (20,)}, **out}
    assert {k: v[0] for k, v in full.items()} == {6: 6, 7: 6, 8: 6, 9: 6, 30: 6, 31: 6, 1: 1, 2: 1, 3: 1, 20: 20, 21: 20}


def test_points_that_share_many_cells_are_compared_once(spark, monkeypatch):
    """Texts below the threshold that share many cells give few pairs to verify, however many cells they share."""
    r = random.Random(5)
    base = [f"w{r.randrange(3000)}" for _ in range(400)]
    rows = [(i, " ".join(w if r.random() > 0.05 else f"x{r.randrange(10**6)}" for w in base)) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 40, 4)]
    made = spark.sparkContext.accumulator(0)
    plain = ngram_join._leaf_pairs

    def counted(*arguments):
        inner = plain(*arguments)

        def run(batches):
            for batch in inner(batches):
                made.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(ngram_join, "_leaf_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = by_id(ngram_join.join_digest(ngram_join.near_duplicates(docs, 5, 80)))
    assert got == brute.jaccard_groups(rows, 5, 80)
    assert made.value <= 4 * len(rows)


def _near(count, seed=6):
    """Texts that share many cells."""
    r = random.Random(seed)
    base = [f"w{r.randrange(3000)}" for _ in range(400)]
    return [(i, " ".join(w if r.random() > 0.02 else f"x{r.randrange(10**6)}" for w in base)) for i in range(count)]


def test_join_keeps_little_more_on_disk_than_its_texts(spark, monkeypatch):
    """What lies in the shared folder for the comparisons is at most a third more than the texts, also where all are compared."""
    folder = checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    rows = [(10 * i + j, f"{t} {t2}") for i in range(40) for (j, t), (_, t2) in zip(_near(2, i), _near(2, -1 - i), strict=True)]
    before, seen = size(), []
    plain = ngram_join._bounded

    def measured(*arguments):
        seen.append(size() - before)
        return plain(*arguments)

    monkeypatch.setattr(ngram_join, "_bounded", measured)
    got = by_id(ngram_join.join_digest(ngram_join.near_duplicates(frame(spark, rows, 2), 5, 80)))
    assert got == brute.jaccard_groups(rows, 5, 80)
    assert 3 * max(seen) < 4 * sum(len(t) for _, t in rows)


def test_verification_moves_pairs_only(spark):
    """Texts lie in buckets: of the shuffles, one deals pairs by a, one by b, and one is that of distinct."""
    docs = frame(spark, _near(12), 2).selectExpr("doc_id id", "text")
    kept = stage_buckets(repeats.packed(docs), "id")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linked = ngram_join._linked(pairs, kept, 5, 10)
        plan = linked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
        assert sorted(map(tuple, linked.collect())) == [(1, 2), (2, 3), (4, 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("answerloom_")]
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    unstage(kept)
    assert not os.path.exists(folder)


def test_verification_of_texts_longer_than_a_slice():
    """Pairs whose texts don't fit one slice are judged alike, whatever stands beside them."""
    long = [f"n{i}" for i in range(150_000)]
    texts = {1: long, 2: [*long, "end"], 3: long[:100_000], 4: ["a", "b"], 5: ["A", "b"], 6: ["b", "a"]}
    press = zstandard.ZstdCompressor(level=1)
    z = {i: press.compress(" ".join(t).encode()) for i, t in texts.items()}
    pairs = [(1, 2), (4, 5), (1, 3), (5, 6), (2, 1), (4, 1), (5, 4)]
    batch = pa.record_batch([[a for a, _ in pairs], [b for _, b in pairs], [z[a] for a, _ in pairs], [z[b] for _, b in pairs]], names=["a", "b", "ta", "tb"])
    found = [tuple(r.values()) for out in ngram_join._verified(3, 90)([batch, batch.slice(0, 0)]) for r in out.to_pylist()]
    assert found == [(1, 2), (4, 5), (2, 1), (5, 4)]
