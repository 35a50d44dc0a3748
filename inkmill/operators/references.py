"""Cross references as an edge table: broken ones and cycles of a bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges (source, target) whose target no anchor (anchor) names."""
    return edges.join(anchors.select(F.col("anchor").alias("target")).distinct(), "target", "left_anti")


def mutual(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page_a, page_b), page_a < page_b: pages that refer to each other; edges: (source, target), anchors: (page_id, anchor).

    A page stands as the ways (own anchor, target) that lead to and from it, and two ways meet where each is the other
    turned round. So no pair is listed that refers one way alone, of which popular anchors have very many.
    """
    own = anchors.select("page_id", F.col("anchor").alias("own")).distinct()
    ways = edges.select(F.col("source").alias("page_id"), "target").distinct().join(own, "page_id")
    # A way that no other turns round goes before any pair is made.
    turned = ways.select(F.col("target").alias("own"), F.col("own").alias("target")).distinct()
    met = ways.join(turned, ["own", "target"], "left_semi")
    a, b = met.alias("a"), met.alias("b")
    pairs = a.join(b, (F.col("a.own") == F.col("b.target")) & (F.col("a.target") == F.col("b.own")) & (F.col("a.page_id") < F.col("b.page_id")))
    return pairs.select(F.col("a.page_id").alias("page_a"), F.col("b.page_id").alias("page_b")).distinct()


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """(node, length): nodes that reach themselves, and the least number of steps, up to `most`.

    Paths are kept as their end points only, so a step's rows are pairs of nodes at that distance; nodes that no edge
    enters or none leaves go first, for they lie on no cycle.
    """
    live = edges.select("source", "target").distinct()
    for _ in range(2):
        live = live.join(live.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(live.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
    paths = live.select(F.col("source").alias("a"), F.col("target").alias("b"))
    found = paths.where("a = b").select(F.col("a").alias("node"), F.lit(1).alias("length"))
    for n in range(2, most + 1):
        paths = paths.where("a <> b").join(live, F.col("b") == F.col("source")).select("a", F.col("target").alias("b")).distinct()
        found = found.unionByName(paths.where("a = b").select(F.col("a").alias("node"), F.lit(n).alias("length")))
    return found.groupBy("node").agg(F.min("length").alias("length"))
