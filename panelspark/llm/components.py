"""Connected components of a link table by alternating star contraction, all in DataFrame joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` for every node with a link; the component is its smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones likewise; the
    links of every round are written below the shared folder; joins never gather a side in the driver. Rounds grow with the logarithm of the longest
    chain. Self links and nulls count as no link; repeated links count once; no links give no rows.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # (u, v) with u > v: every smaller neighbour of u, and u itself, moves to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small.hint("merge"), "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        edges = stored(moved.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
