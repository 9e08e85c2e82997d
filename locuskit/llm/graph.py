"""Connected components of an edge list, by alternating star contractions (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.llm.shared import discard, stash_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest id around that node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties every smaller neighbour of a node, and the node itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`id` and `component_id`, the smallest id reachable, for every id of an edge; self-loops and nulls count for nothing.

    Each round is two equi joins and two aggregations over the edge list, written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. A node with many edges is one key of a join whose large
    partitions Spark splits, and of aggregations that combine before the shuffle.
    """
    spark = edges.sparkSession
    now, path = stash_at(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    while True:
        step, next_path = stash_at(_small_star(_large_star(now).distinct()).distinct(), "edges")
        discard(spark, path)
        now, path = step, next_path
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(now.select("v", "v").distinct())
