"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge; the component is its least node.

    Works for any ordered type. Edges with a null end and loops are ignored; repeated edges count once. The least neighbour of
    each node is an aggregation with map-side combining that is joined back, so no node's neighbours are one task's work,
    however many they are (adaptive execution splits a hot node's join). Rounds are written to the shared folder, each
    removed once the next is there. The number of rounds grows with the logarithm of the longest chain.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large: each greater neighbour to the least of the node and its neighbours; e has every node's lesser ones under u
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small: each lesser neighbour, and the node, to the least of them
        down = large.join(_least(large), "u")
        new = written(down.select("v", "m").union(down.select("u", "m")).toDF("u", "v").where("u <> v").distinct(), "stars")
        discard(large)
        discard(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _settled(e: DataFrame) -> bool:
    """Whether edges from greater to lesser nodes are stars: each node is the end of edges, or the start of one."""
    roles = e.select(F.col("u").alias("node"), F.lit(1).alias("starts"), F.lit(False).alias("ends")).union(e.select("v", F.lit(0), F.lit(True)))
    seen = roles.groupBy("node").agg(F.sum("starts").alias("starts"), F.max("ends").alias("ends"))
    return not seen.where("starts > 1 or starts = 1 and ends").limit(1).count()
