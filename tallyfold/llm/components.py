"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step: every node's neighbours (the larger ones, or the smaller ones and itself) are tied to the
    smallest neighbour."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if small:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label``: the smallest node of the component of each node that has a link.

    ``edges`` has columns ``a`` and ``b`` of one orderable type.  Links of a node to itself
    and repeated links don't matter.  Rounds grow with the logarithm of the longest path;
    each is written to the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s"), F.sum(F.xxhash64("b", "a") % 998244353).alias("t")).first()
        if mark == (now := (seen["n"], seen["s"], seen["t"])) or not seen["n"]:
            break
        mark = now
        edges = cut(_stars(cut(_stars(edges, small=False), name), small=True), name)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
