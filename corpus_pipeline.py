"""A corpus pipeline: documents through the classifier, the near-duplicate join, substring dedup, decontamination and mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.decontamination import benchmark_hits, without_hits
from answerloom.llm.mixing import poisson_mixture, repetition_rates
from answerloom.llm.ngram_join import near_duplicates, one_of_each
from answerloom.llm.quality_classifier import accepted, resampled
from answerloom.llm.queries import table
from answerloom.llm.suffix_dedup import without_repeats
from answerloom.session import stage, unstage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling towards the good labelled ones selects."""
    return accepted(docs, resampled(docs, table(spark, sf_dir, "labels"), seed=42))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at a Jaccard coefficient of 0.8 or more."""
    return one_of_each(docs, near_duplicates(docs, shingle=5, percent=80))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier; n_chars is counted anew."""
    return with_length(without_repeats(docs, min_bytes=100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with a benchmark item."""
    return without_hits(docs, benchmark_hits(docs, table(spark, sf_dir, "benchmark"), window=10))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the square roots of their sources' sizes, in a global random order."""
    return poisson_mixture(docs, repetition_rates(docs, temperature=0.5), seed=42)


def with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifier, the join and the dedup aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each one's table written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, function) in enumerate(STAGES[:-1]):
        before, docs = docs, stage(function(spark, docs, sf_dir))
        if number:
            unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
