"""Connected components of an edge table, in rounds of stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its least node.

    The number of rounds grows with the logarithm of the longest path. Minima
    are folded before the shuffle, and joins rely on adaptive skew splits, so a
    node with a large share of all edges is not gathered in one task. Each round
    is a written table. Self-loops and repeated edges are allowed, nulls are not.
    """
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut_lineage(turned.where("a > b").distinct(), label)
    state = _state(now)
    while state[0]:
        now = cut_lineage(_small_star(_large_star(now)), label)
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
