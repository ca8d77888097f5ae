"""Token counts, quality rules, licences, decontamination and mixing."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
from compare import differences, duck
from fixtures import odd_documents, random_rows
from pyspark.sql import functions as F

from answerloom.llm import decontamination, license_scan, mixing, quality_rules, token_counts
from answerloom.llm.queries import ORACLES, QUERIES, vocabulary

TEXTS = [
    "",
    "Hello World's it's!! <|endoftext|>foo <|startoftext|><|endoftext|> x",
    "日本語 テキスト É ÉCOLE ﬁ Σς ΑΣ    ½ 12345 'll 'S",
    "a'sb 're \x1c \x85 \xa0z\xad a\x1fb",
    "<|endoftext",
    "İstanbul ÅÅÅ \x00 q",
    "Ⅷ ①② 𝒳😀😀👩‍👩‍👧 नमस्ते" * 3,
    " special \x7fx é ́e x ̧",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_token_counts_equal_the_library(spark, sf_dir, library):
    own = token_counts.counter(vocabulary())
    texts = TEXTS + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    wanted = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [own.count(t) for t in texts] == wanted
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r for r in token_counts.token_counts(df, vocabulary(), limit=20, with_prefixes=True).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == wanted
    assert all(got[i]["n_bytes"] == len(t.encode()) for i, t in enumerate(texts))
    for i, text in list(enumerate(texts))[8:60]:
        if wanted[i] > 20:
            words, letters = text.split(), got[i]["fit_letters"]
            whole = got[i]["fit_words"]
            assert got[i]["prefix_counts"][-1] == wanted[i]
            assert len(library.encode(" ".join(words[:whole]), add_special_tokens=False).ids) <= 20
            rest = len(library.encode(" ".join(words[: whole + 1]), add_special_tokens=False).ids)
            assert rest > 20 and 0 <= letters < len(words[whole].encode()) + 1
    other = token_counts.within_budget(token_counts.token_counts(df, vocabulary(), with_prefixes=True), 7).collect()
    assert all(r["over_limit"] == (wanted[r["id"]] > 7) for r in other)


def test_prefixes_of_pieces_equal_the_library(library):
    own = token_counts.counter(vocabulary())
    for piece in ("internationalisation", "thndereaou", "éèouveux", "%%%&&&", "zzzzzzzzzzz"):
        for i in range(1, len(piece) + 1):
            at = len(piece[:i].encode()) - 1
            assert own.prefixes(piece)[at] == len(library.encode(piece[:i], add_special_tokens=False).ids)


def test_base_counts_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6 + i, t, "xx") for i, t in random_rows()], "doc_id long, text string, lang string")
    docs = docs.unionByName(extra)
    got = {r["id"]: r for r in quality_rules.quality_verdicts(docs).collect()}
    for i, text, _ in docs.collect():
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_counts(text)
        assert not (r["base_failed"] and r["kept"])


def test_distances_equal_their_formula(spark):
    df = spark.createDataFrame([([3, 1, 0], [0.5, 0.25, 0.25]), ([0, 0, 0], [1.0, 0.0, 0.0])], "c array<long>, r array<double>")
    got = [r[0] for r in df.select(quality_rules.jensen_shannon(F.col("c"), F.col("r"))).collect()]
    p, q = [0.75, 0.25, 0], [0.5, 0.25, 0.25]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = sum((a * math.log2(a / c) if a else 0) / 2 + (b * math.log2(b / c) if b else 0) / 2 for a, b, c in zip(p, q, m))
    assert got == pytest.approx([math.sqrt(want), 0.0])


def test_verdicts_follow_the_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = quality_rules.quality_verdicts(docs).where("n_words >= 50").join(labels, F.col("id") == F.col("doc_id"))
    share = {r["quality"]: r["s"] for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.15


@pytest.mark.parametrize("name", ["op4_poisson_mixture", "op7_license_scan"])
def test_queries_equal_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) == []


def test_licences(spark):
    texts = ["RELEASED under the (MIT) license", "Licensed under CC BY-NC 4.0.\nmore", "a licence", None, "", "Licensed under\nthe Apache License, Version 2.0\n\nx y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["licenses"] for r in license_scan.license_digest(license_scan.license_notices(df)).orderBy("doc_id").collect()]
    assert got == ["mit", "cc-by-nc-4.0", "", "", "", "apache-2.0"]


@pytest.mark.parametrize("max_windows", [decontamination.MAX_WINDOWS, 40], ids=["one part", "parts"])
def test_decontamination_equals_brute_force(spark, sf_dir, max_windows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:12]
    items += [(900, "Aa, Bb!"), (901, None), (902, " . "), (903, "aa bb cc dd ee ff gg hh ii jj kk"), (900, "Aa, Bb!")]
    rows = [tuple(r) for r in docs.collect()] + [
        (10**6, "x AA bb y aa-bb-cc dd ee ff gg hh ii jj kk ll"),
        (10**6 + 1, None),
        (10**6 + 2, "aa bb aa bb"),
        (10**6 + 3, f"so {items[0][1]} it is, {items[1][1]}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontamination.benchmark_hits(df, bench, max_windows=max_windows)
    got = {r[0]: tuple(r[1:]) for r in decontamination.decontamination_digest(hits).collect()}
    assert got == brute.benchmark_digest(rows, items)
    spans = {r["id"]: r["spans"] for r in hits.collect()}
    raw = rows[-4][1].encode()
    assert [raw[s["start"] : s["end"]].decode() for s in spans[10**6]] == ["AA bb", "aa-bb-cc dd ee ff gg hh ii jj kk"]
    assert {r[0] for r in decontamination.without_hits(df, hits).select("doc_id").collect()} == {i for i, v in got.items() if not v[-1]}


def test_mixture_follows_the_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("none", 5.0)], "source string, weight double")
    rates = mixing.repetition_rates(docs, weights, total=40_000)
    assert {r["source"]: round(r["rate"], 6) for r in rates.collect()} == {"big": round(10_000 / 3000, 6), "small": 30.0}
    out = mixing.poisson_mixture(docs, rates)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 10_000) < 5 * 100 and abs(n["small"] - 30_000) < 5 * 174
    per_row = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last")).collect()
    assert all(r["n"] == r["last"] for r in per_row)
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    again = mixing.poisson_mixture(docs.repartition(7), rates)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, "the old mill by the river for a day of rest"), (None, None)], "item_id long, text string")
    for df, n in ((docs, 9), (docs.limit(0), 0)):
        assert token_counts.token_counts(df, vocabulary()).count() == n
        assert quality_rules.quality_verdicts(df).count() == n
        assert license_scan.license_digest(license_scan.license_notices(df)).count() == n
        hits = decontamination.benchmark_hits(df, bench)
        assert hits.count() == n and decontamination.without_hits(df, hits).columns == docs.columns
        assert decontamination.benchmark_hits(df, bench.limit(0)).where("n_hit > 0").count() == 0
        mixed = mixing.poisson_mixture(df, mixing.repetition_rates(df))
        assert mixed.columns == [*docs.columns, "copy", "shuffle_key"] and mixed.count() <= 10 * n
    found = {r["id"]: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert found[1]["n_words"] == 0 and found[1]["base_failed"] and not found[1]["kept"]


def test_words_of_equal_sums_have_names_of_their_own():
    import pyarrow as pa

    from answerloom.llm.arrays import words

    turn = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(11):
        word += word.translate(turn)
    names = words(pa.array([f"{word} {word.translate(turn)} {word}"]))[3]
    assert names[0] == names[2] != names[1]


def test_parts_of_a_test_set_keep_rows_apart(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, passage), (1, "clean text"), (None, passage), (None, "all clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, passage), (1, " ".join(f"q{i}" for i in range(15)))], "item_id long, text string")
    for limit in (100_000, 3):
        got = sorted((r.id or 0, r.n_hit) for r in decontamination.benchmark_hits(docs, bench, max_windows=limit).collect())
        assert got == [(0, 0), (0, 12), (1, 0), (1, 12)]


def test_stages_take_columns_named_like_their_own(spark):
    import corpus_pipeline
    from answerloom.llm import ngram_join, quality_classifier, suffix_dedup

    docs = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(6)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(("__hit", "__gone", "__rejected", "a.b"))})
    bench = spark.createDataFrame([(0, "text number 3 " * 9)], "item_id long, text string")
    assert decontamination.without_hits(docs, decontamination.benchmark_hits(docs, bench)).columns == docs.columns
    assert ngram_join.one_of_each(docs, ngram_join.near_duplicates(docs, 5, 80)).columns == docs.columns
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality_classifier.accepted(docs, quality_classifier.resampled(docs, labels)).columns == docs.columns
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert corpus_pipeline.STAGES


def test_long_segments_are_judged_by_their_head(spark):
    """What a head rules out has too many bigrams; a long segment of few bigrams stays a candidate."""
    notice = license_scan.TEMPLATES["mit"]
    rows = [
        (1, " ".join(f"w{i}" for i in range(2000))),
        (2, (notice + " ") * 200),
        (3, " ".join(f"W{i % 40} w{i % 40}" for i in range(2000)) + "\n" + notice),
        (4, "w" * 5000 + " " + notice),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in df.select(license_scan.may_have(F.col("text"), 56.0)).collect()] == [False, True, True, True]
    got = {r.doc_id: (r.n_candidates, r.n_notices) for r in license_scan.license_digest(license_scan.license_notices(df)).collect()}
    want = {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1)}
    assert got == want
