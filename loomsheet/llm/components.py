"""Connected components by alternating large-star and small-star.

Both steps keep connectivity and never make more edges than there were. A
hub's edges are never gathered: minima come from a partially aggregated
groupBy, and edges meet their node's minimum in a join that salts hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.llm import common

#: Alternations in which even a path of 2^40 nodes has become stars.
MOST = 80


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges``: (u, v) with u > v. Large-star links larger neighbours, small-star the smaller ones, to the smallest of all."""
    around = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = common.hot_lookup(around, least, "u", "v")
    if small:
        linked = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        linked = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: pairs (x, y) of longs. Returns (node, component), the component being its smallest node; nodes without a link are absent."""
    spark = links.sparkSession
    edges = links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    edges, path = common.stored(edges, "edges")
    mark = None
    for _ in range(MOST):
        after, after_path = common.stored(_star(edges, small=False), "large-star")
        edges, new = common.stored(_star(after, small=True), "small-star")
        for old in (path, after_path):
            common.remove(spark, old)
        path = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
    raise RuntimeError("components didn't settle")
