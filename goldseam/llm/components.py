"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung below the smallest node of the neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    hung = both.join(least, "u").where("v > u")
    return hung.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its lower neighbours are hung below the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has two columns of one orderable type; loops, nulls and repeated edges are ignored.
    Each round joins every edge with one aggregate per node (folded before the shuffle, so a hub is
    no hot group) and writes the shrunken edges to the shared folder. It ends when a round changes
    nothing; the number of rounds grows with the logarithm of the component sizes.
    """
    a, b = edges.columns
    clean = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    now = staged(clean.distinct(), purpose)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(now)
    while before[0]:
        now = staged(_small_star(_large_star(now)), purpose)
        after = mark(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
