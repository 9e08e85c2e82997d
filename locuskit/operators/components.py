"""Connected components by star contractions, and descendants level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.session import removed, written


def _contracted(edges: DataFrame) -> DataFrame:
    """One round over edges from a larger node (a) to a smaller one (b).

    First every larger neighbour of a node is tied to the least node around it, then every node and its smaller neighbours to
    the least of them. Both keep what is connected, and the edges become stars. Each step is a least value by key, combined
    before the shuffle, and an equi join whose large keys Spark splits.
    """
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`node`, `root` (the smallest node reachable) for every node; edges have columns a and b, each once or twice.

    Rounds of contraction, written each time, until the edges stay as they are: the longest path halves with every round, and
    what is already a star isn't joined with labels of all nodes again and again.
    """
    spark = nodes.sparkSession
    one = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, path = written(one, "edges")
    before = None
    while True:
        step, next_path = written(_contracted(now), "edges")
        removed(spark, path)
        now, path = step, next_path
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out, _ = written(nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "labels")
    removed(spark, path)
    return out


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes below the roots, roots included, by following (parent, child) edges level by level until nothing new is found."""
    spark = edges.sparkSession
    found, path = written(roots.select("node").distinct(), "closure")
    front, front_path = found, None
    while True:
        below = edges.join(front, edges["parent"] == front["node"]).select(F.col("child").alias("node")).distinct().join(found, "node", "left_anti")
        below, below_path = written(below, "closure")
        if not below.limit(1).count():
            break
        grown, grown_path = written(found.union(below), "closure")
        removed(spark, path)
        if front_path:
            removed(spark, front_path)
        found, path, front, front_path = grown, grown_path, below, below_path
    return found
