"""Analysing a new version of a document by what has changed in it.

Blocks are known by the hash of their type and content; the k-th block of a hash in the old version is the k-th in the new
one. `aligned` tells, by one fold over a document's matches, which of them keep their order (a longest increasing run of old
places), the others have moved. `rerun` analyses only the blocks without a match; issues of matched blocks are carried over
with their spans shifted to the block's new place. As a block's issues depend on the block alone, the result is that of a
full run. Matching and carrying are joins by document and hash; the fold holds one document's matches.

Null types and contents count as empty; repeated blocks match as often as both versions have them; a document in one
version only is new, or gone with its issues; empty tables give none. (doc_id, block_idx) must not repeat in a version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACE = "array<struct<old: int, id: int>>"


def snapshot(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_idx, block_type, content) with h, the k-th of its hash, and offset, its place in the document."""
    text, kind = F.coalesce("content", F.lit("")), F.coalesce("block_type", F.lit(""))
    hashed = blocks.withColumns({"h": F.sha2(F.concat(F.length(kind).cast("string"), F.lit("|"), kind, text), 256), "size": F.length(text)})
    before = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    kth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("block_idx"))
    return hashed.withColumns({"k": kth, "offset": F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0))}).drop("size")


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, old_idx, new_idx, shift) of the blocks of two snapshots that are the same."""
    was = old.select("doc_id", "h", "k", F.col("block_idx").alias("old_idx"), F.col("offset").alias("was"))
    return new.join(was, ["doc_id", "h", "k"]).select("doc_id", "old_idx", F.col("block_idx").alias("new_idx"), (F.col("offset") - F.col("was")).alias("shift"))


def _kept(olds: Column) -> Column:
    """The positions, from 0, of a longest increasing subsequence of an array of ints."""
    begin = F.struct(F.array().cast(PLACE).alias("tails"), F.array().cast("array<int>").alias("before"))

    def step(s: Column, x: Column) -> Column:
        # The last elements of the best runs of each length, in order: x takes the place of the first that is not below it.
        n = F.size(F.filter(s["tails"], lambda t: t["old"] < x))
        here = F.struct(x.cast("int").alias("old"), F.size(s["before"]).alias("id"))
        tails = F.concat(F.slice(s["tails"], F.lit(1), n), F.array(here), F.slice(s["tails"], n + 2, F.greatest(F.size(s["tails"]) - n - 1, F.lit(0))))
        prior = F.coalesce(F.try_element_at(s["tails"], F.when(n > 0, n).otherwise(F.size(s["tails"]) + 1))["id"], F.lit(-1))
        return F.struct(tails.alias("tails"), F.concat(s["before"], F.array(prior)).alias("before"))

    folded = F.aggregate(olds, begin, step)
    last = F.coalesce(F.try_element_at(folded["tails"], F.lit(-1))["id"], F.lit(-1))
    back = F.struct(last.alias("at"), F.array().cast("array<int>").alias("kept"), folded["before"].alias("before"))
    # One step back for each element of a run.
    walk = lambda s, _: F.struct(F.when(s["at"] >= 0, F.get(s["before"], s["at"])).otherwise(-1).alias("at"), F.when(s["at"] >= 0, F.concat(s["kept"], F.array(s["at"]))).otherwise(s["kept"]).alias("kept"), s["before"].alias("before"))
    return F.aggregate(folded["tails"], back, walk)["kept"]


def aligned(matches: DataFrame) -> DataFrame:
    """matches with moved: false for a longest run of blocks whose order is the same in both versions."""
    lists = matches.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("new_idx", "old_idx", "shift"))).alias("l"))
    runs = lists.select("doc_id", "l", _kept(F.transform("l", lambda x: x["old_idx"])).alias("kept"))
    each = runs.select("doc_id", "kept", F.posexplode("l").alias("at", "x"))
    return each.select("doc_id", "x.old_idx", "x.new_idx", "x.shift", (~F.array_contains("kept", F.col("at"))).alias("moved"))


def rerun(old: DataFrame, new: DataFrame, issues: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Issues of the new snapshot: carried ones of matched blocks, and analyse(blocks) of all others.

    issues and what analyse gives: (doc_id, block_idx, start, end) in the document, and more columns; analyse sees blocks
    with their offset. Adds carried.
    """
    same = matched(old, new)
    moved = issues.withColumnRenamed("block_idx", "old_idx").join(same, ["doc_id", "old_idx"])
    carried = moved.withColumns({"block_idx": F.col("new_idx"), "start": F.col("start") + F.col("shift"), "end": F.col("end") + F.col("shift")}).select(*issues.columns, F.lit(True).alias("carried"))
    changed = new.join(same.select("doc_id", F.col("new_idx").alias("block_idx")), ["doc_id", "block_idx"], "left_anti")
    return carried.unionByName(analyse(changed).select(*issues.columns).withColumn("carried", F.lit(False)))
