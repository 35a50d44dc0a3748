"""Trees of blocks: parents by heading levels, nested-set numbers and hierarchical counters at any depth.

Numbers come by pointer doubling: each round joins every block with its 2^k-th ancestor, so a forest of depth d takes
log2(d) rounds, whatever its shape. A label is the blocks' ranks among their siblings from the root on; labels in order are
the blocks in document order, each parent before its children.

Parents that are not there make roots; parents that form a cycle raise; an empty table gives no rows; (keys, id) must not
repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rounds import cut


def parents_by_level(blocks: DataFrame, deepest: int = 6) -> DataFrame:
    """blocks (doc_id, block_idx, block_type, level) with parent_idx: of a heading, the last one before it of a lesser level; of others, the last heading.

    One window whatever the number of levels: the last heading of each level so far.
    """
    order = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.col("block_type") == "heading"
    last = lambda k: F.max(F.when(heading & (F.least("level", F.lit(deepest)) == k), F.col("block_idx"))).over(order)
    marked = blocks.withColumns({f"_h{k}": last(k) for k in range(deepest + 1)})
    lesser: Column = F.lit(None).cast("int")
    for k in range(deepest + 1):
        lesser = F.greatest(lesser, F.when(~heading | (F.least("level", F.lit(deepest)) > k), F.col(f"_h{k}")))
    return marked.select(*blocks.columns, lesser.alias("parent_idx"))


def numbered(nodes: DataFrame, keys: tuple[str, ...] = ("doc_id",), id: str = "block_idx", parent: str = "parent_idx") -> DataFrame:
    """(keys, id, parent, depth, number, size, lft, rgt, place) of each node of a forest.

    number: the ranks from the root on ("1.2.3"); size: of the subtree; lft, rgt: nested-set numbers of the key's forest;
    place: the node's in document order. A node lies below another if its lft is between that one's lft and rgt.
    """
    keys_, node = list(keys), nodes.select(*keys, F.col(id).alias("v"), F.col(parent).alias("p"))
    there = node.select(*keys, F.col("v").alias("p")).withColumn("found", F.lit(True))
    node = node.join(there, [*keys_, "p"], "left").select(*keys, "v", F.when(F.col("found"), F.col("p")).alias("p"))
    rank = F.row_number().over(Window.partitionBy(*keys, "p").orderBy("v"))
    state = cut(node.select(*keys, "v", "p", F.col("p").alias("up"), F.array(rank).alias("label"), F.lit(1).cast("long").alias("size")))
    rounds, most = 0, state.count()
    while state.where("up IS NOT NULL").take(1):
        if (rounds := rounds + 1) > most.bit_length() + 1:
            raise ValueError("parents form a cycle")
        below = state.where("up IS NOT NULL").groupBy(*keys, F.col("up").alias("v")).agg(F.sum("size").alias("more"))
        above = state.select(*keys, F.col("v").alias("up"), F.col("up").alias("next"), F.col("label").alias("head"))
        joined = state.join(above, [*keys_, "up"], "left").join(below, [*keys_, "v"], "left")
        label = F.when(F.col("head").isNull(), F.col("label")).otherwise(F.concat("head", "label"))
        state = cut(joined.select(*keys, "v", "p", F.col("next").alias("up"), label.alias("label"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("label")).cast("long")
    placed = state.select(*keys, F.col("v").alias(id), F.col("p").alias(parent), (F.size("label") - 1).alias("depth"), F.array_join(F.col("label").cast("array<string>"), ".").alias("number"), "size", place.alias("place"))
    # Before a node, place - 1 nodes have opened, and all of them but its ancestors have closed.
    return placed.withColumns({"lft": 2 * F.col("place") - 1 - F.col("depth"), "rgt": 2 * F.col("place") - 2 - F.col("depth") + 2 * F.col("size")})
