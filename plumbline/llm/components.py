"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import land


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = land(edges.union(edges.select("b", "a")), "both")
    least = land(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return _pairs(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = land(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    return _pairs(down.join(least, "a").select("b", "m").toDF("a", "b").union(least.select("a", "m").toDF("a", "b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (a, b); the component is its smallest node. Runs until nothing changes."""
    now = land(_pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    mark = None
    while True:
        now = land(_small_star(_large_star(now)), "stars")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct().toDF("id", "component"))
