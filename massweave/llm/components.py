"""Connected components of a table of links, by alternating star joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(v, c) of every linked number: c is the smallest number that it reaches. ``links``: u, v."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    state = None
    while True:
        # Large star: neighbours above a node move to the smallest of its neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: a node and its lower neighbours move to the lowest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = written(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = fresh.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        dropped(edges)
        edges = fresh
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("v"), F.col("v").alias("c")).union(edges.select(F.col("v"), F.col("v").alias("c")).distinct())
