"""Connected components by alternating star contractions; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import materialise


def _links(df: DataFrame, child, parent) -> DataFrame:
    return df.select(child.alias("a"), parent.alias("b")).where("a <> b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _links(both.join(least, "a").where("b > a"), F.col("b"), F.col("m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    up = _links(joined, F.col("b"), F.col("m"))
    return up.unionByName(_links(least, F.col("a"), F.col("m"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    edges: (a, b) with integer ends in any direction; self-links and repeats are allowed, null ends are not.
    Each round is written to the shared folder, which cuts lineage and survives lost executors. A node with very
    many links only meets partial minima and a join that Spark may split.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = materialise(_links(ends, F.col("a"), F.col("b")).distinct(), "links"), None
    for _ in range(rounds):
        now = materialise(_small_star(_large_star(now)), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
