"""Connected components of an edge table, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of a table (a, b) of longs; the component is its smallest node.

    Alternates large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014): minima come from partial aggregates, edges go back to them by a join whose skewed nodes
    Spark splits, and each round is written to the shared folder, so that the plan stays short.
    """
    now = stored(_smaller(edges.filter(F.col("a") != F.col("b"))), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
    lower = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return lower.union(now.select(F.col("b"), F.col("b")).distinct())


def _smaller(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least"))).distinct()
