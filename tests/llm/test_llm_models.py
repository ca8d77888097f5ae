"""Quality classifier and toxicity on held-out labels, their exact parts against brute force, and the pipeline."""

import os
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
from fixtures import odd_documents, odd_labels
from pyspark.sql import functions as F

from answerloom.llm import quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_classifier_on_held_out_labels(documents, labels):
    learned = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sample = quality_classifier.resampled(documents, learned)
    held = labels.join(learned, "doc_id", "left_anti").join(sample, F.col("id") == F.col("doc_id"))
    share = {r["quality"]: r["s"] for r in held.groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2
    kept = quality_classifier.accepted(documents, sample)
    assert kept.columns == documents.columns and kept.count() == sample.where("selected").count()


def test_top_k_is_exact(documents, labels, monkeypatch):
    monkeypatch.setattr(quality_classifier, "BIN_ROWS", 5)
    sample = quality_classifier.resampled(documents, labels, k=137).collect()
    keys = sorted((r["sample_key"] for r in sample), reverse=True)
    assert sum(r["selected"] for r in sample) == 137
    assert min(r["sample_key"] for r in sample if r["selected"]) == keys[136]


def test_weights_are_sums_of_log_ratios():
    texts = ["A b, b b c", "", "x"]
    bucket, text = quality_classifier.gram_buckets(pa.array(texts), 1 << 16)
    names, first = quality_classifier.token_names(pa.array(texts))
    assert list(np.diff(first)) == [6, 0, 1] and list(np.bincount(text, minlength=3)) == [11, 0, 1]
    assert names[4] == 1 and names[3] == 2  # the word before, and the one before the comma


@pytest.mark.parametrize("block", [16, 512])
def test_nearest_examples_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    r = np.random.default_rng(7)
    rows = []
    for i in range(700):
        terms = np.sort(r.choice(40, size=r.integers(1, 6), replace=False))
        weights = r.random(len(terms)) + 0.05
        rows.append((i, int(r.integers(2)), terms, weights / np.sqrt((weights**2).sum())))
    index = toxicity.BlockMaxIndex(rows, 40)
    dense = np.zeros((len(rows), 40))
    for i, _, t, w in rows:
        dense[i, t] = w
    for i in range(0, 700, 23):
        _, _, terms, weights = rows[i]
        found, cosines = index.nearest(terms, weights, 10)
        want = np.sort(dense @ dense[i])[::-1][:10]
        assert np.allclose(cosines, want[want > 0][: len(cosines)]) and len(cosines) == min(10, (want > 0).sum())
        assert np.allclose(dense[index.ids[found]] @ dense[i], cosines)
        assert i not in index.ids[index.nearest(terms, weights, 10, but=i)[0]]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.toxicity_scores(docs.join(labels, "doc_id", "left_semi"), labels)
    held = scored.where("held_out").join(labels, F.col("id") == F.col("doc_id")).toPandas()
    hits = ((held.toxic == 1) & (held.predicted == 1)).sum()
    assert hits / (held.toxic == 1).sum() > 0.85 and hits / (held.predicted == 1).sum() > 0.9
    assert ((held.score - held.toxic) ** 2).mean() < 0.03 and held.score.between(0, 1).all()


def test_labels_of_held_out_rows_are_not_used(documents, labels):
    out = toxicity.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r["id"]: r["score"] for r in toxicity.toxicity_scores(documents, labels).collect()}
    assert one == {r["id"]: r["score"] for r in toxicity.toxicity_scores(documents, flipped).collect()}


def test_isotonic_map():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.allclose(y, [0, 0.5, 1]) and np.allclose(x, [0.1, 0.25, 0.4])


def test_odd_rows_and_empty_tables(spark):
    docs, labels = odd_documents(spark), odd_labels(spark)
    for df, own, n in ((docs, labels, 9), (docs, labels.limit(0), 9), (docs.limit(0), labels, 0)):
        sample = quality_classifier.resampled(df, own)
        assert sample.count() == n and quality_classifier.accepted(df, sample).columns == docs.columns
        scores = toxicity.toxicity_scores(df, own)
        assert scores.count() == n and scores.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = P.table(spark, SF, "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in P.table(spark, SF, "labels").collect()}
    sizes = []
    for name, function in P.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = P.stage(function(spark, docs, SF))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        sizes.append(len(after))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality classifier":
            gone = [labels[i] for i, _ in before if i not in after and i in labels]
            assert sum(gone) == 0 and len(gone) > 0.8 * sum(v == 0 for v in labels.values())
        elif name == "n-gram Jaccard join":
            groups = brute.jaccard_groups(before, 5, 80)
            assert set(after) == {i for i, (_, first) in groups.items() if i == first}
        elif name == "suffix-array dedup":
            wanted = brute.byte_dedup(before)
            assert all(len(after.get(i, "").encode()) <= n - gone for i, (n, gone, _, _) in wanted.items())
            assert all(after[i] == t for i, t in before if wanted[i][1] == 0)
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in P.table(spark, SF, "benchmark").collect()]
            found = brute.benchmark_digest(before, items)
            assert set(after) == {i for i, v in found.items() if not v[-1]}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
