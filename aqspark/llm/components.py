"""Connected components of an undirected graph that no one task can hold."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.llm.batches import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of an edge (a, b) with the smallest node of its component.

    Large-star and small-star steps in turn, until nothing changes: each node's neighbours are tied to the
    smallest of them. The edges stay as many as the nodes or fewer, and the number of rounds grows with the logarithm of
    the nodes. Every step is written, so a lost executor costs one step.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "edges")
    seen = None
    while True:
        # large star: larger neighbours go to the smallest neighbour (or the node itself)
        sides = _both_ways(now)
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.where("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # a star: every node points to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
