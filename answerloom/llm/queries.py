"""Registered queries of this subpackage, and the SQL that must give the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.conversation_trie import conversation_trie, turn_sequences, with_shared_heads
from answerloom.llm.decontamination import benchmark_hits, decontamination_digest
from answerloom.llm.html_extraction import main_texts
from answerloom.llm.license_scan import license_digest, license_notices, license_sql
from answerloom.llm.mixing import poisson_mixture, repetition_rates
from answerloom.llm.ngram_join import join_digest, near_duplicates
from answerloom.llm.periodic_runs import periodic_runs, run_digest, with_repeated_tails
from answerloom.llm.quality_classifier import resampled
from answerloom.llm.quality_rules import quality_verdicts
from answerloom.llm.substring_dedup import substring_dedup_digest
from answerloom.llm.suffix_dedup import suffix_dedup_digest
from answerloom.llm.token_counts import token_counts
from answerloom.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_suffix_dedup(spark, sf_dir):
    """Strings of 100 bytes that start earlier are removed from every document."""
    return suffix_dedup_digest(table(spark, sf_dir, "documents"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_counts(spark, sf_dir):
    """Exact token counts of every document, and what fits 2048 tokens."""
    counts = token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=2048)
    return counts.select(
        F.col("id").alias("doc_id"),
        *("n_bytes", "n_tokens"),
        (F.col("n_tokens") > 2048).alias("over_limit"),
        *("fit_words", "fit_letters"),
    )


@query
def op4_poisson_mixture(spark, sf_dir):
    """All documents mixed by the square roots of their sources' sizes, with their texts, in a global random order."""
    docs = table(spark, sf_dir, "documents")
    mixed = poisson_mixture(docs, repetition_rates(docs, temperature=0.5), seed=42)
    return mixed.select("doc_id", "source", "copy", "shuffle_key", "text")


ORACLES["op4_poisson_mixture"] = """
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) * weight / (SELECT sum(weight) FROM sizes) / n AS rate FROM sizes),
parts AS (SELECT source, ceil(rate / 8.0)::INT AS parts, rate / greatest(ceil(rate / 8.0), 1) AS mean FROM rates),
terms AS (SELECT source, parts, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM parts, range(48) AS r(k)),
sums AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draws AS (SELECT d.doc_id, d.source, p.part,
    ('0x' || substr(md5('42:' || d.doc_id || ':' || p.part), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN (SELECT source, unnest(range(1, parts + 1)) AS part FROM parts) p ON p.source = d.source),
copies AS (SELECT w.doc_id, count(s.k)::INT AS n FROM draws w JOIN sums s ON s.source = w.source AND s.c <= w.u GROUP BY w.doc_id)
SELECT d.doc_id, d.source, e.copy::INT AS copy, md5('42:' || d.doc_id || ':' || e.copy || ':order') AS shuffle_key, d.text
FROM documents d JOIN (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM copies) e ON e.doc_id = d.doc_id
"""


@query
def op10_benchmark_decontamination(spark, sf_dir):
    """What every document shares with the test items, by windows of ten words."""
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return decontamination_digest(hits)


@query
def op7_license_scan(spark, sf_dir):
    """Licence notices of every document."""
    return license_digest(license_notices(table(spark, sf_dir, "documents")))


ORACLES["op7_license_scan"] = license_sql()


@query
def op3_quality_rules(spark, sf_dir):
    """Base counts of every document, and the verdict by its histograms' distance from its language."""
    verdicts = quality_verdicts(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return verdicts.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept")


@query
def op6_substring_dedup(spark, sf_dir):
    """Sequences of 20 words that start earlier are removed from every document."""
    return substring_dedup_digest(table(spark, sf_dir, "documents"), min_words=20)


@query
def op5_ngram_jaccard_join(spark, sf_dir):
    """Near-duplicate components of all documents: three-word shingles, Jaccard of 0.9 or more."""
    return join_digest(near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=90))


@query
def op8_quality_classifier(spark, sf_dir):
    """All documents weighed against the good labelled ones; those kept are the resampled corpus."""
    sample = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), seed=42)
    return sample.withColumnsRenamed({"id": "doc_id", "selected": "kept"})


@query
def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document, by its nearest labelled examples."""
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), seed=42)
    return scores.withColumnRenamed("id", "doc_id")


@query
def op11_html_extraction(spark, sf_dir):
    """Main texts of all pages, without what markup or the other pages of their host tell to be boilerplate."""
    return main_texts(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


#: For pages whose articles are headings and paragraphs, and for the references that these use.
ORACLES["op11_html_extraction"] = r"""
WITH articles AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(replace(body, '<br>', ' '), '</?b>', '', 'g'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS b
  FROM articles),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""


@query
def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of all documents, a tenth of which are made to repeat a block to their end."""
    return run_digest(periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents"))))


@query
def op13_conversation_trie(spark, sf_dir):
    """Trie of the beginnings of all conversations, each with first turns of the first one of its block."""
    return conversation_trie(with_shared_heads(turn_sequences(table(spark, sf_dir, "conversations"))))


ORACLES["op13_conversation_trie"] = """
WITH bits AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
turns AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, turn,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'d': digest, 'c': chars} ORDER BY turn NULLS FIRST, digest) AS seq,
    (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6)::INT AS h
  FROM turns CROSS JOIN bits GROUP BY conv_id, t),
rebuilt AS (
  SELECT o.conv_id, list_concat(CASE WHEN d.seq IS NULL THEN [] ELSE d.seq[1:o.h] END, o.seq[o.h + 1:]) AS seq
  FROM own o LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 100),
prefixes AS (
  SELECT conv_id, len(seq) AS turns, d AS depth, array_to_string(list_transform(seq[1:d], lambda x: x.d), '') AS node,
    array_to_string(list_transform(seq[1:d - 1], lambda x: x.d), '') AS parent, CASE WHEN d > 0 THEN seq[d].c ELSE 0 END AS chars
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT a.node, a.depth, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes a JOIN nodes b ON starts_with(b.node, a.node) LEFT JOIN kids k ON k.parent = b.node AND k.depth = b.depth
  GROUP BY a.node, a.depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent AND p.depth = n.depth - 1
"""
