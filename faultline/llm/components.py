"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum (combined before the shuffle) and a join back on stored tables, so a hub with a third of all
edges is split by the adaptive skew join; no node's neighbours meet in one task and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component): for each node that has an edge, the smallest node it reaches. Null ends and loops are left out."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now, before = stored(now, "cc-edges"), None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "cc-low")
        large = stored(both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct(), "cc-large")
        discard(now)
        discard(low)
        low = stored(large.groupBy("v").agg(F.min("u").alias("m")), "cc-low")
        down = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = stored(down.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "cc-edges")
        discard(large)
        discard(low)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
