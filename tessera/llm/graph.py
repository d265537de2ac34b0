"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links (a, b)."""
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)), F.coalesce(F.sum(F.hash("v", "u", F.lit(1)).cast("long")), F.lit(0))).first())
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    named = edges.unionByName(edges.select(F.col("v").alias("u"), "v"))  # the least node of each has no smaller one
    return named.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
