"""A trie over the turn prefixes of conversations.

1. Each turn becomes 16 bytes of the SHA-256 of its role and text, each conversation one binary path of its turns in order.
2. Paths are range-sorted over the whole table (path, then id), so that conversations with a common prefix are adjacent.
   The sorted partitions go to the checkpoint folder, where their borders and order stay as they are.
3. Each partition is swept once. The common prefix (LCP) with the path before it tells which nodes of the open stack end
   and which begin; a node's interval of rows gives its members, children, leaves and saved tokens, all of them sums.
4. The LCPs at partition borders are known beforehand (one number a partition), so a node that crosses borders leaves one
   part a partition, and its parts add up to exactly the node: open stacks are stitched by one small aggregate.
5. Parents' names come by a join within a partition (part, parent), whose groups are bounded by a partition's rows.

A group of equal conversations may fill many partitions: its rows are sorted by id, each partition leaves its run of ids
as one piece of text, and only these pieces meet, in order, to be hashed. A task holds one stack (as deep as the longest
conversation), the ids of a run within its partition, and no lists of members otherwise. One conversation's turns, 20
bytes each, must fit a task.

Rows of a null conv_id belong to no conversation and are left out; a null role or text is the empty string, which differs
from no turn at all; null turns come first; of equal turn numbers the order is that of their hashes; repeated rows are
turns of their own; empty and very long texts are turns like any other; an empty table gives no nodes; columns other than
conv_id, turn, role and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bytes of a turn in a path.
WIDTH = 16

SWEPT = "part int, id binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary, open boolean"
_SWEPT = pa.schema([
    ("part", pa.int32()), ("id", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    ("ends_sha256", pa.string()), ("ends", pa.binary()), ("open", pa.bool_()),
])
#: Nodes in a batch that a sweep hands on.
BATCH = 4096


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of turn, digest (hexadecimal) and size (code points)."""
    role, text = common.text_of("role"), common.text_of("text")
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * WIDTH))
    one = F.struct("turn", digest.alias("digest"), F.length(text).alias("size"))
    return turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def rebuilt(found: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin as the first one of their block of `every` ids: its first h turns, then their own after h.

    h is the unsigned CRC-32 of the decimal id modulo `heads`; the block's first conversation may have fewer turns or be absent.
    """
    base, h = F.col("conv_id") - F.pmod("conv_id", F.lit(every)), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    firsts = found.where(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    begun = found.withColumn("base", base).join(firsts, "base", "left")
    return begun.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), h), own)).alias("turns"))


def _path(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: t.digest), ""))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[: WIDTH * middle] == b[: WIDTH * middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    """A node of the open stack. Sums run over the rows of its interval seen in this partition."""

    __slots__ = ("children", "continued", "ends", "id", "leaves", "least", "n", "saved", "size")

    def __init__(self, id: bytes, size: int, continued: bool):
        self.id, self.size, self.continued = id, size, continued
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends = None, []


class _Sweep:
    """One pass over a partition's sorted rows. before, after: the LCPs at its two borders, -1 where nothing adjoins."""

    def __init__(self, part: int, before: int, after: int):
        self.part, self.before, self.after = part, before, after
        self.stack: list[_Node] = []
        self.last: bytes | None = None
        self.out: list[tuple] = []

    def push(self, path: bytes, sizes: list[int], continued_to: int) -> None:
        if not self.stack:
            self.stack.append(_Node(b"", 0, self.before >= 0))
        for d in range(len(self.stack), len(path) // WIDTH + 1):
            top, new = self.stack[-1], d > continued_to
            top.children += new
            step = hashlib.blake2b(top.id + path[WIDTH * (d - 1) : WIDTH * d], digest_size=16).digest()
            self.stack.append(_Node(step, sizes[d - 1], not new))

    def pop(self, open_to: int) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        # Each member but the first of all has the node's last text anew; the first is in the part that began the node.
        node.saved += (node.n - (not node.continued)) * node.size
        if self.stack:
            up = self.stack[-1]
            up.n, up.leaves, up.saved = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved
            up.least = node.least if up.least is None else min(up.least, node.least)
        part_only, ends = node.continued or depth <= open_to, b",".join(node.ends)
        hashed = None if part_only else hashlib.sha256(ends).hexdigest()
        parent = self.stack[-1].id if self.stack else None
        self.out.append((self.part, node.id, parent, depth, node.least, node.n, node.children, node.leaves, node.saved, hashed, ends if part_only and node.ends else None, part_only))

    def to(self, depth: int, open_to: int = -1) -> None:
        """The last row is over: it ends a leaf unless all of it goes on. Nodes deeper than depth end."""
        if max(depth, open_to) < len(self.last) // WIDTH:
            self.stack[-1].leaves += 1
        while len(self.stack) > depth + 1:
            self.pop(open_to)

    def row(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        if self.last is None:
            shared = self.before
        else:
            shared = _shared(self.last, path)
            self.to(shared)
        self.push(path, sizes, self.before if self.last is None else -1)
        top = self.stack[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ends.append(b"%d" % conv_id)
        self.last = path

    def end(self) -> None:
        if self.last is not None:
            self.to(-1, self.after)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SWEPT, strict=True)], schema=_SWEPT)


def _borders(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition that has rows: the LCPs of its first row with the one before and of its last with the one after."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() if first is None else first
                last = batch.column(0)[batch.num_rows - 1].as_py()
        if first is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["part", "first", "last"])

    def lcps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [-1 if a is None else _shared(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["part", "shared"])

    # Two rows a partition, whatever the number of conversations.
    edges = ordered.select("path").mapInArrow(ends, "part int, first binary, last binary")
    met = edges.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"), "first").mapInArrow(lcps, "part int, shared long")
    rows = sorted((r.part, r.shared) for r in met.collect())
    return {part: (shared, rows[k + 1][1] if k + 1 < len(rows) else -1) for k, (part, shared) in enumerate(rows)}


def _hashed(pieces: DataFrame) -> DataFrame:
    """(id, ends_sha256) for pieces (id, part, ends) of the id lists of nodes that cross borders: hashed in order, one piece in memory."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])
        for batch in batches:
            for k in range(batch.num_rows):
                node, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if node == now:
                    state.update(b",")
                else:
                    if now is not None:
                        yield done()
                    now, state = node, hashlib.sha256()
                state.update(text)
        if now is not None:
            yield done()

    return pieces.repartition("id").sortWithinPartitions("id", "part").select("id", "ends").mapInArrow(hashes, "id binary, ends_sha256 string")


def trie(found: DataFrame) -> DataFrame:
    """One row for each node of the trie over found (conv_id, turns): every distinct sequence of first turns, the root's too.

    conv_id: the least member; depth; parent_conv_id: the least member of the parent; n_convs: members; n_children; n_leaves
    of the subtree; saved_tokens of the subtree; ends_sha256 over the ids of the members that end here.
    """
    spark = found.sparkSession
    common.ship(spark)
    path = common.workspace(spark)
    rows = found.select("conv_id", _path(F.col("turns")).alias("path"), F.transform("turns", lambda t: t.size).alias("sizes"))
    ordered = common.written(rows, f"{path}/paths").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").checkpoint()
    borders = spark.sparkContext.broadcast(_borders(ordered))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        swept = _Sweep(part, *borders.value.get(part, (-1, -1)))
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                swept.row(*row)
                while len(swept.out) >= BATCH:
                    yield _batch(swept.out[:BATCH])
                    del swept.out[:BATCH]
        swept.end()
        for k in range(0, len(swept.out), BATCH):
            yield _batch(swept.out[k : k + BATCH])

    nodes = common.written(ordered.select("conv_id", "path", "sizes").mapInArrow(sweep, SWEPT), f"{path}/swept")
    whole, parts = nodes.where("NOT open"), nodes.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    met = parts.groupBy("id").agg(F.min("part").alias("part"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    met = met.join(_hashed(parts.where("ends IS NOT NULL").select("id", "part", "ends")), "id", "left")
    stitched = common.written(met.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))), f"{path}/stitched")
    names = whole.where("n_children > 0").select("part", F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    names = names.unionByName(parts.select("part", "id").join(stitched.select("id", F.col("conv_id").alias("parent_conv_id")), "id").withColumnRenamed("id", "parent"))
    each = whole.select(stitched.columns).unionByName(stitched)
    return each.join(names, ["part", "parent"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(common.table(spark, sf_dir, "conversations"))))


#: crc32 of a decimal id, bit by bit; then prefixes as lists of turns.
SQL = {
    "op12_conversation_trie": """
WITH bytes AS (SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)) AS codes FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda s, i: xor(s >> 1, 3988292384 * (s & 1))))) % 6 AS h FROM bytes),
seqs AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
whole AS (SELECT s.conv_id, list_concat(coalesce(b.t[1:h], []), s.t[h + 1:]) AS t FROM seqs s JOIN heads USING (conv_id) LEFT JOIN seqs b ON b.conv_id = s.conv_id - s.conv_id % 100),
members AS (SELECT conv_id, d, t[1:d] AS p, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM whole)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS e FROM members GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
facts AS (SELECT n.*, coalesce(k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * length(n.p[n.d].text) END AS own FROM nodes n LEFT JOIN kids ON kids.d = n.d AND kids.p = n.p),
above AS (SELECT p[1:a] AS p, a AS d, sum(own) AS saved, count(*) FILTER (WHERE k = 0) AS leaves FROM (SELECT p, own, k, unnest(range(d + 1)) AS a FROM facts) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, f.n AS n_convs, CAST(f.k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.e) AS ends_sha256
FROM facts f JOIN above a ON a.d = f.d AND a.p = f.p LEFT JOIN facts up ON up.d = f.d - 1 AND f.d > 0 AND up.p = f.p[1:f.d - 1]"""
}
