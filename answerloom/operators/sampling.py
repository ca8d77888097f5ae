"""Exact, seeded sampling that no partitioning, retry or input order can change.

The permutation orders rows by a uniform digest of seed and row identity. The
leading digits of the digest name a bucket, so positions need no global sort:
count rows per bucket (a small map-side aggregate), turn the counts into
offsets, rank inside each bucket. Buckets are even by construction whatever the
data looks like, and nothing has to be persisted between the passes because
both are pure functions of the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.columns import CORPUS, Corpus
from answerloom.functions.seeding import order_key
from answerloom.session import stage

_KEY, _BUCKET, _BEFORE = "_order_key", "_bucket", "_before"
# 16 ** 4 buckets: at ten billion rows about 150,000 rows each.
BUCKET_DIGITS = 4
# Where offsets of several groups are broadcast, fewer buckets keep them small.
GROUPED_DIGITS = 3
# Parts in which the first rows of a group are looked for before the last choice.
FIRST_N_PARTS = 64


def _bucketed(df: DataFrame, seed: int, ids: Sequence[str], digits: int) -> DataFrame:
    keyed = df.withColumn(_KEY, order_key(seed, *[F.col(c) for c in ids]))
    return keyed.withColumn(_BUCKET, F.substring(_KEY, 1, digits))


def bucket_sizes(df: DataFrame, seed: int, ids: Sequence[str], digits: int = BUCKET_DIGITS) -> DataFrame:
    """Rows in each bucket of the permutation; their sum is the number of rows. At most 16 ** digits rows."""
    return _bucketed(df.select(*ids), seed, ids, digits).groupBy(_BUCKET).agg(F.count("*").alias("_n"))


def seeded_positions(
    df: DataFrame,
    seed: int,
    ids: Sequence[str],
    by: Sequence[str] = (),
    out: str = "position",
    below: int | Column | None = None,
    counting: Column | None = None,
    total: str | None = None,
    digits: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Append the 0-based position of each row in the seeded permutation of its ``by`` group.

    ``ids`` must identify a row. ``below`` keeps only positions under it, dropping whole
    buckets before the shuffle. ``counting`` numbers only the rows where it holds and gives
    null to the others. ``total`` names a column for the number of numbered rows of the group.
    ``by`` is for few groups, such as splits or AI columns. With ``by`` and ``below`` the digest gives one digit
    less for buckets, as one set of offsets per group is broadcast; positions don't depend on the number of digits.
    ``sizes`` saves a pass where the caller has staged the ``bucket_sizes`` of these rows.
    """
    by = list(by)
    if digits is None:
        digits = GROUPED_DIGITS if by and below is not None else BUCKET_DIGITS
    keyed = _bucketed(df, seed, ids, digits)
    counted = F.lit(True) if counting is None else counting
    if sizes is None:
        sizes = keyed.groupBy(*by, _BUCKET).agg(F.count_if(counted).alias("_n"))
    # At most 16 ** digits rows per group meet in this window.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    ahead = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum("_n").over(group).alias(total)] if total else []
    offsets = sizes.select(*by, _BUCKET, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias(_BEFORE), *totals)
    if below is not None:
        # Bounded by 16 ** digits rows per group, so it may be broadcast to prune before the shuffle.
        offsets = F.broadcast(offsets.where(F.col(_BEFORE) < below))
    placed = keyed.join(offsets, [*by, _BUCKET])
    inside = Window.partitionBy(*by, _BUCKET).orderBy(_KEY, *ids)
    if counting is None:
        position = F.col(_BEFORE) + F.row_number().over(inside) - 1
    else:
        running = F.sum(counted.cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        position = F.when(counted, F.col(_BEFORE) + running - 1)
    result = placed.withColumn(out, position.cast("long"))
    if below is not None:
        result = result.where(F.col(out) < below)
    return result.select(*df.columns, out, *([total] if total else []))


def permute(df: DataFrame, seed: int, ids: Sequence[str] = ("split", "row_id"), out: str = "position") -> DataFrame:
    """Seeded global shuffle, as a dense position column."""
    return seeded_positions(df, seed, ids, out=out)


def train_eval_split(
    df: DataFrame,
    train_size: int,
    eval_size: int,
    seed: int,
    names: Corpus = CORPUS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Cut exact-size disjoint train and eval splits; positions restart at 0 in each.

    The old identity goes to the origin columns where they are missing, and the position in the
    new split becomes the row id. The rows are counted by the bucket sizes that the permutation needs anyway, so they
    are read twice in all; ``sizes`` are these if the caller has staged them.
    """
    if train_size <= 0 or eval_size <= 0:
        raise ValueError("train_size and eval_size must be positive.")
    wanted = train_size + eval_size
    ids = [names.split, names.row_id]
    sizes = stage(bucket_sizes(df, seed, ids)) if sizes is None else sizes
    have = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if wanted > have:
        raise ValueError(f"Requested {wanted:,} rows but only {have:,} usable rows are available.")
    if names.origin_split not in df.columns:
        df = df.withColumns({names.origin_split: F.col(names.split), names.origin_index: F.col(names.row_id)})
    chosen = seeded_positions(df, seed, ids, out="_position", below=wanted, sizes=sizes)
    to_train = F.col("_position") < train_size
    return chosen.withColumns(
        {
            names.split: F.when(to_train, "train").otherwise("eval"),
            names.row_id: F.when(to_train, F.col("_position")).otherwise(F.col("_position") - train_size),
        }
    ).drop("_position")


def subsample(
    examples: DataFrame,
    max_samples: int | None,
    seed: int,
    by: Sequence[str] = ("split", "ai_column"),
    ids: Sequence[str] = ("example_id", "ai_column"),
) -> DataFrame:
    """The first examples of the seeded shuffle per group; pairs may be split, as examples are drawn singly."""
    if max_samples is None:
        return examples
    if max_samples <= 0:
        raise ValueError("max_samples must be positive.")
    return seeded_positions(examples, seed, ids, by, "_position", below=max_samples).drop("_position")


def sweep_sizes(sizes: Sequence[int], available: int) -> list[int]:
    """Requested training sizes without repeats, in order; each within the rows there are."""
    if not sizes:
        raise ValueError("Pass at least one training size.")
    for size in sizes:
        if size <= 0:
            raise ValueError("Training sizes must be positive.")
        if size > available:
            raise ValueError(f"Requested {size:,} train rows, but split only has {available:,} rows.")
    return list(dict.fromkeys(sizes))


def size_subsets(
    df: DataFrame, sizes: Sequence[int], seed: int, ids: Sequence[str] = ("split", "row_id"), out: str = "train_rows"
) -> DataFrame:
    """Nested subsets of one permutation, a row repeated once per size it belongs to."""
    placed = seeded_positions(df, seed, ids, out="_position", below=max(sizes))
    wanted = F.array(*[F.lit(int(s)).cast("long") for s in sizes])
    return placed.withColumn(
        out, F.explode(F.filter(wanted, lambda size: F.col("_position") < size))
    ).drop("_position")


def sample_rows(df: DataFrame, k: int, seed: int, ids: Sequence[str] = ("split", "row_id")) -> DataFrame:
    """``k`` seeded rows, or all if there are fewer; order the result as needed."""
    if k <= 0:
        raise ValueError("The sample size must be positive.")
    return seeded_positions(df, seed, ids, out="_position", below=k).drop("_position")


def first_n(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows in the given order, per group.

    Every task keeps at most ``n`` rows of a group, and the rows kept meet in parts of the group
    before they meet in the group, so that no task gets ``n`` rows from every other one.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(FIRST_N_PARTS))

    def leading(rows: DataFrame, groups: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    parted = leading(df.withColumn("_part", part), [*by, "_part"]).drop("_part")
    return leading(parted, list(by)) if by else parted.orderBy(*order).limit(n)
