"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node's neighbours and itself; ``edges`` holds (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): each node of ``edges`` (u, v) with the least id it reaches.

    Alternating large-star and small-star steps: in turn every node links its larger,
    then its smaller neighbours to the least node near it, until each component is one
    star. A step is a grouped minimum and a join, so a node of any degree is spread.
    """
    now = settle(
        edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct()
    )
    state = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct())
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return settle(now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots))
