"""Seeded draws that are pure functions of the row.

A draw hashes ``seed:split:row:salt``; nothing depends on partitioning, task
order or retries, and the same digest exists in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Stands for a null part of a key.
NULL_PART = "\u2400"


def _column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def seed_key(*parts) -> Column:
    """Parts joined by ``:``; plain values are taken literally, and a null part is not the same as none."""
    return F.concat_ws(":", *[F.coalesce(_column(p).cast("string"), F.lit(NULL_PART)) for p in parts])


def order_key(seed: int, *ids: Column) -> Column:
    """Sort key of the seeded permutation: uniform hex digest of seed and row identity."""
    return F.md5(seed_key(seed, *ids))


def hash32(*parts) -> Column:
    """First 32 bits of the digest as a non-negative long."""
    return F.conv(F.substring(F.md5(seed_key(*parts)), 1, 8), 16, 10).cast("long")


def hash60(*parts) -> Column:
    """First 60 bits of the digest as a non-negative long: for draws among more than a few million."""
    return F.conv(F.substring(F.md5(seed_key(*parts)), 1, 15), 16, 10).cast("long")


def draw(bound: Column, *parts) -> Column:
    """Seeded integer in ``[0, bound)``; 0 where the bound is not positive."""
    return F.pmod(hash32(*parts), F.greatest(bound.cast("long"), F.lit(1).cast("long")))
