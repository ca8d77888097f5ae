"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.session import stage

#: A mean above this is drawn as a sum of equal parts, each at most so large.
PART_MEAN = 8.0
#: Terms of a part's distribution; what lies beyond has less than 1e-15 of its mass.
TERMS = 48
#: Hex digits of the digest that make a draw: 52 bits, which a double holds exactly.
DIGITS = 13


def uniform(*parts) -> Column:
    """A number in [0, 1) from the digest of its parts; null counts as the text 'null'."""
    texts = [F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("null")) for p in parts]
    digest = F.md5(F.concat_ws(":", *texts))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def cumulative(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, ... TERMS - 1."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums")),
        lambda state, k: F.struct(
            (state.p * mean / k).alias("p"),
            F.array_append(state.sums, F.element_at(state.sums, -1) + state.p * mean / k).alias("sums"),
        ),
        lambda state: state.sums,
    )
    return step


def repetition_rates(
    docs: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = 0.5,
    total: float | None = None,
    source_col: str = "source",
) -> DataFrame:
    """One row per source: source, n, rate, parts, sums.

    `weights` has columns source and weight; without it the weight of a source is its number of rows to the power
    `temperature`. A source's rate is the mean number of copies of each of its rows: total * weight share / n, where
    `total` is the expected number of rows of the mixture (default: as many as there are). A source that `weights`
    lacks, or whose weight is null or negative, has rate 0. Null is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("n", F.lit(temperature)))
    else:
        given = weights.select(F.col("source").alias("__source"), F.greatest("weight", F.lit(0.0)).alias("weight"))
        given = given.groupBy("__source").agg(F.max("weight").alias("weight"))
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        weighted = weighted.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighted = stage(weighted)
    sums = weighted.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    rows = float(total if total is not None else sums["n"] or 0)
    rate = F.col("weight") * F.lit(rows / sums["weight"] if sums["weight"] else 0.0) / F.col("n")
    parts = F.ceil(F.col("rate") / PART_MEAN).cast("int")
    return (
        weighted.select("source", "n", rate.alias("rate"))
        .withColumn("parts", parts)
        .withColumn("sums", cumulative(F.col("rate") / F.greatest("parts", F.lit(1))))
    )


def poisson_mixture(
    docs: DataFrame,
    rates: DataFrame,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Every row as often as its draw says, in a random order: the columns of `docs`, copy, shuffle_key.

    A row's number of copies is Poisson distributed with its source's rate: the inverse distribution at a number
    made from the digest of seed, id and part. It depends on nothing else, so a retried task repeats it. `copy` counts
    from 1. The order is that of a digest of seed, id and copy: a global shuffle that any run repeats.

    Nulls: a null source is a source of its own, a null id is drawn as id 'null'. Rows that repeat an id get equal
    draws. Texts aren't looked at. Columns named copy, shuffle_key or with a leading `__` are replaced by the new
    ones or may not occur. An empty table gives an empty result.
    """
    rates = stage(rates.select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("sums").alias("__sums")))
    key = F.col(id_col)
    rows = docs.drop("copy", "shuffle_key").join(rates, F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")),
        F.lit(0),
        lambda sum_, part: sum_ + F.size(F.filter("__sums", lambda c: c <= uniform(seed, key, part))),
    )
    rows = rows.where("__parts > 0").withColumn("__copies", copies).where("__copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), F.col("copy").cast("string"), F.lit("order")))
    return rows.withColumn("shuffle_key", digest).drop("__source", "__parts", "__sums", "__copies").orderBy("shuffle_key", id_col, "copy")
