"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum by node and a join; no node's neighbours are gathered. Every round's edges go to the shared
checkpoint folder, so the lineage stays short and lost executors lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v. Larger neighbours of each node, or the smaller ones and itself, to its least neighbour."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge (a, b); component: the least node of its component."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    mark = _mark(now)
    while mark[0]:
        now = _star(_star(now, True), False).checkpoint()
        if mark == (mark := _mark(now)):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
