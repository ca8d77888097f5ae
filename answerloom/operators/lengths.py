"""Answer-length profiles.

The corpus is read once into a frequency table ``(answer_column, length, n)``;
statistics, cap and histogram all run on that small table and are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import count_lexical_words
from answerloom.operators.flatten import answers_long

#: Size of a quantile sketch: a column takes some ten kilobytes, and a rank is off by about a thousandth at most.
SKETCH_SIZE = 4096
LENGTH_UNITS: dict[str, Callable[[Column], Column]] = {"words": count_lexical_words, "chars": F.length}


def explode_answers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per non-blank answer of every answer column."""
    return answers_long(df, columns, keep).select(*keep, "answer_column", F.explode("answers").alias("answer"))


def _measure(unit: str, token_length: Callable[[Column], Column] | None) -> Callable[[Column], Column]:
    if unit == "tokens":
        if token_length is None:
            raise ValueError("The unit 'tokens' needs token_length.")
        return token_length
    if unit not in LENGTH_UNITS:
        raise ValueError(f"Unknown length unit '{unit}'.")
    return LENGTH_UNITS[unit]


def length_frequencies(
    df: DataFrame, columns: Sequence[str], unit: str = "words", token_length: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Number of answers per column and length.

    The unit ``tokens`` needs a tokenizer, given as a function from a text column to a count column
    (a vectorized UDF).
    """
    measure = _measure(unit, token_length)
    lengths = explode_answers(df, columns).select("answer_column", measure(F.col("answer")).alias("length"))
    return lengths.groupBy("answer_column", "length").agg(F.count(F.lit(1)).alias("n"))


def _column_list(freq: DataFrame, columns: Sequence[str]) -> DataFrame:
    return freq.sparkSession.createDataFrame([(c,) for c in columns], "answer_column string")


def length_stats(freq: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, min, mean, median, p90, p95, p99 and max per column; a column without answers has n = 0."""
    shares = F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)])
    stats = freq.groupBy("answer_column").agg(
        F.sum("n").alias("n"),
        F.min("length").alias("min"),
        F.try_divide(F.sum(F.col("length") * F.col("n")).cast("double"), F.sum("n").cast("double")).alias("mean"),
        F.percentile("length", shares, F.col("n")).alias("_p"),
        F.max("length").alias("max"),
    )
    # At most one row per column.
    return _column_list(freq, columns).join(F.broadcast(stats), "answer_column", "left").select(
        "answer_column",
        F.coalesce("n", F.lit(0)).alias("n"),
        "min",
        "mean",
        *[F.col("_p")[i].alias(name) for i, name in enumerate(("median", "p90", "p95", "p99"))],
        "max",
    )


def length_cap(freq: DataFrame, max_length: int | None = None, percentile_cap: float = 99.5) -> DataFrame:
    """One row ``cap``: the longest visible length over all columns pooled, null for no cap."""
    if max_length is not None:
        if max_length <= 0:
            raise ValueError("max_length must be positive.")
        return freq.sparkSession.range(1).select(F.lit(max_length).cast("long").alias("cap"))
    if percentile_cap >= 100:
        return freq.sparkSession.range(1).select(F.lit(None).cast("long").alias("cap"))
    if percentile_cap <= 0:
        raise ValueError("percentile_cap must be in (0, 100].")
    # Equal lengths of all columns merge first, so the pooled aggregate sees each length once.
    pooled = freq.groupBy("length").agg(F.sum("n").alias("n"))
    at = F.percentile("length", F.lit(percentile_cap / 100), F.col("n"))
    return pooled.agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.round(at, 9))).alias("cap"))


def visible(freq: DataFrame, cap: DataFrame) -> DataFrame:
    """Lengths within the cap; ``cap`` is one row."""
    limited = freq.join(F.broadcast(cap))
    return limited.where(F.col("cap").isNull() | (F.col("length") <= F.col("cap")))


def length_histogram(freq: DataFrame, cap: DataFrame, bins: int = 80) -> DataFrame:
    """Density over ``bins`` equal bins from 0 to the cap, the last one closed, empty bins included."""
    if bins <= 0:
        raise ValueError("bins must be positive.")
    # Edges and grid hold one row per answer column.
    shown = visible(freq, cap)
    edges = shown.groupBy("answer_column").agg(
        F.sum("n").alias("visible_n"),
        F.greatest(F.lit(1).cast("long"), F.coalesce(F.max("cap"), F.max("length").cast("long"))).alias("upper"),
    )
    grid = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    # Integer arithmetic puts every length on the exact side of a bin edge.
    bin_of = F.expr(f"cast(least(length * {bins}L div upper, {bins - 1}L) as int)")
    upper = F.broadcast(edges.select("answer_column", "upper"))
    placed = shown.join(upper, "answer_column").withColumn("bin", bin_of)
    counts = placed.groupBy("answer_column", "bin").agg(F.sum("n").alias("bin_n"))
    width = F.col("upper") / F.lit(bins)
    return grid.join(counts, ["answer_column", "bin"], "left").select(
        "answer_column",
        "bin",
        F.coalesce("bin_n", F.lit(0)).alias("bin_n"),
        ((F.col("bin") + 0.5) * width).alias("center"),
        F.try_divide(F.coalesce("bin_n", F.lit(0)).cast("double"), F.col("visible_n") * width).alias("density"),
    )


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Share of the answers by which a sketch's rank may be off, in 99 of 100 cases."""
    return 2.446 / size**0.9433


def length_sketches(
    df: DataFrame,
    columns: Sequence[str],
    unit: str = "words",
    token_length: Callable[[Column], Column] | None = None,
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """A mergeable quantile sketch of the lengths of each column: answer_column, n, min, max, sketch.

    For corpora that grow: a run sketches the rows that came, and ``merged_sketches`` joins it to what earlier runs kept,
    so no answer is measured twice. Every task keeps one sketch for each column.
    """
    lengths = explode_answers(df, columns).select("answer_column", _measure(unit, token_length)(F.col("answer")).cast("long").alias("length"))
    return lengths.groupBy("answer_column").agg(
        F.count("*").alias("n"),
        F.min("length").alias("min"),
        F.max("length").alias("max"),
        F.kll_sketch_agg_bigint("length", size).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch for each column from those of several runs or parts."""
    return sketches.groupBy("answer_column").agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )


def sketched_stats(sketches: DataFrame) -> DataFrame:
    """n, min, median, p90, p95, p99 and max of each column; quantiles are lengths whose rank is within ``rank_error``."""
    shares = F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)])
    found = merged_sketches(sketches).withColumn("_p", F.kll_sketch_get_quantile_bigint("sketch", shares))
    quantiles = [F.col("_p")[i].alias(name) for i, name in enumerate(("median", "p90", "p95", "p99"))]
    return found.select("answer_column", "n", "min", *quantiles, "max")


def sketched_cap(sketches: DataFrame, percentile_cap: float = 99.5) -> DataFrame:
    """One row ``cap``, as ``length_cap`` gives it, by the sketches of all columns pooled; within ``rank_error``."""
    if not 0 < percentile_cap < 100:
        raise ValueError("percentile_cap must be in (0, 100).")
    pooled = sketches.agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    at = F.kll_sketch_get_quantile_bigint("sketch", F.lit(percentile_cap / 100))
    return pooled.select(F.greatest(F.lit(1).cast("long"), at).alias("cap"))
