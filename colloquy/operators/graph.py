"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

MOST_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the greater neighbours of each node to the least of the node and its neighbours; edges, here and below, have a > b."""
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = edges.unionByName(up).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return up.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    others = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down, or edges up only: then components are found, and another round would change nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down")))
    counts = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return counts.agg(F.count_if((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("least") == 0)))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node that can be reached."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MOST_ROUNDS):
        edges = checkpointed(_small_star(_large_star(edges)))
        if _are_stars(edges):
            break
    else:
        raise RuntimeError(f"components did not converge in {MOST_ROUNDS} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
