"""The graph of modules: strong components of any length, and the layers of what depends on what.

Components by forward and backward reachability: the greatest name that reaches a node is its colour; nodes that are
reached from backwards, within a colour, from the node that gave it are that node's component. Edges between colours lie in
no component and go. Each round passes names along edges, one join and one maximum; no pairs of nodes are listed, and a
colour settles at least one component. Nodes that no edge enters or none leaves are components of their own and go first.

Layers: nodes that nothing leads to are layer 0, and each round takes off the next one.

Edges are (source, target); repeated ones count once, those with a null end are left out, loops make no layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import cut


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges that may lie on a cycle: rounds that drop edges from nodes without an entry, and to nodes without an exit."""
    n = edges.count()
    while n:
        inner = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        edges = cut(inner.select("source", "target"))
        if n == (n := edges.count()):
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest name that leads to each node, its own included."""
    state = cut(_ends(edges).select("node", F.col("node").alias("colour"), F.lit(True).alias("news")))
    while state.where("news").take(1):
        told = state.where("news").join(edges, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("heard"))
        better = F.coalesce(F.col("heard") > F.col("colour"), F.lit(False))
        state = cut(state.join(told, "node", "left").select("node", F.when(better, F.col("heard")).otherwise(F.col("colour")).alias("colour"), better.alias("news")))
    return state.select("node", "colour")


def _leading_back(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, colour) of the nodes from which edges within their colour lead to the node that gave it."""
    found = cut(colours.where("node = colour"))
    fresh = found
    while fresh.take(1):
        before = edges.join(fresh.select(F.col("node").alias("target"), "colour"), ["target", "colour"]).select(F.col("source").alias("node"), "colour").distinct()
        fresh = cut(before.join(found, "node", "left_anti"))
        found = cut(found.unionByName(fresh))
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component, size): component is the least node of those that lead to each other."""
    edges = cut(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
    nodes, done = _ends(edges), None
    live = _trimmed(edges.where("source <> target"))
    while live.take(1):
        colours = _coloured(live)
        own = colours.withColumnRenamed("node", "source")
        inside = live.join(own, "source").join(colours.select(F.col("node").alias("target"), F.col("colour").alias("there")), "target").where("colour = there").select("source", "target", "colour")
        found = _leading_back(cut(inside), colours)
        done = found if done is None else cut(done.unionByName(found))
        rest = inside.join(found.select(F.col("node").alias("source")), "source", "left_anti").join(found.select(F.col("node").alias("target")), "target", "left_anti")
        live = _trimmed(cut(rest.select("source", "target")))
    if done is None:
        return nodes.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    rooted = nodes.join(done, "node", "left").select("node", F.coalesce("colour", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return rooted.join(names, "root").select("node", "component", "size")


def layers(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(component, layer) of the graph between components (node, component, size): the longest way that leads to each."""
    name = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    live = cut(edges.join(name("source"), "source").join(name("target"), "target").where("source_c <> target_c").select(F.col("source_c").alias("source"), F.col("target_c").alias("target")).distinct())
    waiting, done, n = cut(found.select("component").distinct()), None, 0
    while True:
        entered = live.select(F.col("target").alias("component")).distinct()
        free = waiting.join(entered, "component", "left_anti").withColumn("layer", F.lit(n))
        done = cut(free if done is None else done.unionByName(free))
        waiting = cut(waiting.join(entered, "component", "left_semi"))
        if not waiting.take(1):
            return done
        live, n = cut(live.join(waiting.select(F.col("component").alias("source")), "source", "left_semi")), n + 1
