"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.session import stage, unstage


def connected_components(links: DataFrame) -> DataFrame:
    """Nodes of a link table (a, b) with the smallest node each can reach: node, component.

    Every step connects the neighbours of a node to the smallest of them: first the larger neighbours, then the
    smaller ones, until each node hangs directly on its smallest. The number of links never grows and the number of
    steps is logarithmic. Each step's links are a written table, which takes the
    place of the one before.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        former, edges = edges, stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        unstage(former)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))  # read from a written table


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("digest")).first()
    return row["n"], row["digest"] or 0
