"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay distributed: each round is two aggregations and two joins. A node with very many links is one hot join
key; adaptive skew joins split it, as both sides come from plain shuffles. The rounds stop when the links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import materialise, remove


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: long columns u and v. Returns (node, component) for every linked node that isn't itself the smallest
    of its component; component is the smallest node reachable. Loops, nulls and repeated links are ignored."""
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = links.where("u is not null and v is not null and u <> v").select(u.alias("u"), v.alias("v")).distinct()
    now, path = materialise(now, "links")
    seen = None
    while True:
        after, next_path = materialise(_small_star(_large_star(now)), "links")
        mark = after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first()
        remove(now.sparkSession, path)
        now, path = after, next_path
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
