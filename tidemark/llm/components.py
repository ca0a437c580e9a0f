"""Connected components of a large graph by alternating large-star and small-star steps.

Edges never leave the executors; each round ends in a table in the shared folder, and the round
before it is deleted. A hub with any number of neighbours is split by Spark's skew join, as both
sides of each join are plain shuffles of stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _to_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link what stands around each node with the least of it: larger neighbours, or all smaller ones."""
    if both_ways:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = cut(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-least")
    joined = around.join(least, "u")
    if both_ways:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.union(least.where("u > m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = cut(out.where("a <> b").distinct(), "cc-edges")
    drop(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node with an edge; edges has a and b, longs.

    Empty input gives an empty table. Loops and repeated edges do no harm; nulls are no nodes.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    before = _state(edges)
    while before[0]:  # every round but the last brings labels down, so this ends
        large = _to_least(edges, both_ways=True)
        small = _to_least(large, both_ways=False)
        drop(large)
        drop(edges)
        edges, now = small, _state(small)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(edges.select(F.col("b"), F.col("b")).distinct())
