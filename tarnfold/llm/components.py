"""Connected components of an edge table, distributed, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's neighbours (large: those above it; else those below and itself) on its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    hung = both.join(least, "u")
    if large:
        moved = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, component), the least node reachable, for each node but the least ones."""
    now = common.stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
        now = common.stored(star(star(now, True), False), "links")


def of_stars(edges: DataFrame) -> DataFrame:
    """edges (doc, root) from local components, each root with an edge to itself -> (doc, component).

    Only docs with several roots tie roots together, so the iteration runs over roots alone.
    """
    least = edges.groupBy("doc").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    several = least.where("least != most").select("doc", "least")
    tied = common.stored(edges.join(several, "doc").where("root != least").select(F.col("root").alias("u"), F.col("least").alias("v")).distinct(), "tied")
    own = least.select("doc", F.col("least").alias("node"))
    if tied.isEmpty():
        return own.select("doc", F.col("node").alias("component"))
    return own.join(connected(tied), "node", "left").select("doc", F.coalesce("component", "node").alias("component"))
