"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.base import checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; the component is the smallest node reachable.

    Only smallest neighbours are aggregated, never neighbour lists, so hubs pre-aggregate; the tables
    of smallest neighbours are written so that joins on hubs read plain shuffles, which adaptive skew handling can split. Loops and repeated edges are allowed.
    """
    lower, upper = F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")
    edges = checkpoint(edges.where("u != v").select(upper, lower).distinct(), "components")  # u > v
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "components")
        large = (both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = checkpoint(large, "components")
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")), "components")
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
                 .where("u != v").distinct())
        edges = checkpoint(small, "components")
        new = _state(edges)
        if new == state:
            break
        state = new
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
