"""Similarity join on three-word shingles by signature trees: Jaccard of 0.9 or more.

A text is lower-cased (A to Z) and split into words; its set is that of its runs of three words (the whole sequence if
there are fewer), each as a 64-bit hash. A text without words has the empty set and is linked with nothing.

1. Equal sets are one class, numbered once and written with its number.
2. A forest: shingles are ordered by rarity (seen more than once in a sample of the texts: last, by count; the order has no
   say in the result), and sets enter the trees of their first n - ceil(0.9 n) + 1 shingles. Sets within the threshold
   share at least one of these, so no pair is lost between trees, and none meets at a shingle that most sets have.
3. Each set meets the hub (most copied set) of its trees first. A large group of near copies is linked by as many meetings
   as it has sets. Hubs are done with then; shingles of two sets need no tree.
4. Trees: a leaf holds sets of one size class with like min-hash bits; nodes above hold 16 nodes each, up to the size
   class and the shingle. A node has the OR of its sets' bitmaps, their size range, the most shingles that a set has beyond
   its bits, and whether all are of one component. The dual traversal begins with the pairs of size classes and goes down
   both sides at once. A pair of nodes goes if the sizes lie too far apart, if it holds one component only, or if no two
   sets in it can overlap enough: common bits and shingles beyond bits bound the overlap of any two.
5. Pairs of sets that are left are verified on whole sets; those that hold are links.

Null ids do not count as names (a component of null ids only has a null name); repeated rows, and ties, share a class; null,
empty and blank texts are alone; very long texts are sets like any other; an empty table gives no rows; columns other than
the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WINDOW = 3
#: Jaccard threshold as a fraction.
UP, DOWN = 9, 10
#: Words of a bitmap, 64 bits each.
WORDS = 8
#: As many for the pairs that the trees leave.
WIDE = 64
#: Bits of the min-hash that the levels below the size class take; each level has 16 children.
LEVELS = (0, 4, 8, 12)
#: One text in so many is looked at for the order of the shingles; so many common ones are told apart at most.
SAMPLE, COMMON = 32, 131_072
#: Texts of so many sets at most are picked by a broadcast of their ids.
BROADCAST_SETS = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Stands for a null id where rows are looked up.
NO_ID = -(1 << 63)
BITMAP = [f"b{j}" for j in range(WORDS)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    return h ^ (h >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingles of a whole text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h = _mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
    if not words:
        return h
    k = min(WINDOW, len(words))
    runs = sum((_mixed(h[j : len(h) - k + 1 + j] + _ODD[j]) * _ODD[j] for j in range(k)), np.zeros(len(h) - k + 1, dtype=np.uint64))
    return np.unique(_mixed(runs + np.uint64(k)))


def prefix_size(n: int) -> int:
    return n - (n * UP + DOWN - 1) // DOWN + 1 if n else 0


def _sampled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order, and their rarity classes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["w"])

    some = rows.where(F.pmod("th", F.lit(SAMPLE)) == 0).select("t").mapInArrow(each, "w long")
    found = some.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(COMMON).collect()
    words, counts = np.array([r.w for r in found], dtype=np.int64).view(np.uint64), np.array([int(3 * math.log2(r.n)) for r in found], dtype=np.int64)
    order = np.argsort(words)
    return words[order], counts[order]


def _marked(rows: DataFrame) -> DataFrame:
    """Each row's set: its 128-bit hash, size, rarest shingles in order, bitmap, shingles beyond bits, min-hash."""
    shared = rows.sparkSession.sparkContext.broadcast(_sampled(rows))
    schema = "i long, th long, c binary, n int, prefix array<long>, bitmap array<long>, beyond int, least_hash int"

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = shared.value
        for batch in batches:
            keys, sizes, prefixes, maps, beyond, least = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                bits = np.zeros(64 * WORDS, dtype=bool)
                bits[s & np.uint64(64 * WORDS - 1)] = True
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    order = np.lexsort((s, np.where(known[at] == s, classes[at], 0)))
                else:
                    order = np.arange(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                prefixes.append(s[order[: prefix_size(len(s))]].view(np.int64))
                maps.append(np.packbits(bits).view(np.int64))
                beyond.append(len(s) - int(bits.sum()))
                least.append(int((s * _ODD[0]).min() >> np.uint64(40)) if len(s) else 0)
            long_lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, long_lists), pa.array(maps, long_lists), pa.array(beyond, pa.int32()), pa.array(least, pa.int32())],
                names=["i", "th", "c", "n", "prefix", "bitmap", "beyond", "least_hash"],
            )

    return rows.select("i", "th", "t").mapInArrow(marks, schema)


def _sizes_fit(a: str, b: str) -> str:
    return f"{UP} * {a} <= {DOWN} * {b} AND {UP} * {b} <= {DOWN} * {a}"


def _need(a: str, b: str) -> str:
    """SQL: the least overlap of two linked sets of sizes a and b."""
    return f"(({UP} * ({a} + {b}) + {UP + DOWN - 1}) div {UP + DOWN})"


def _common_bits(a: str, b: str, column: str = "") -> str:
    return " + ".join(f"bit_count({a}.{column}{x} & {b}.{column}{x})" for x in BITMAP)


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, path: str) -> DataFrame:
    """The pairs (x, y) of class numbers whose whole sets are similar enough, written."""
    marks = classes.select("k", "n", "beyond", *[F.col("bitmap")[j].alias(b) for j, b in enumerate(BITMAP)])
    both = pairs.join(marks.alias("a"), F.col("x") == F.col("a.k")).join(marks.alias("b"), F.col("y") == F.col("b.k"))
    likely = common.written(both.where(f"{_common_bits('a', 'b')} + least(a.beyond, b.beyond) >= {_need('a.n', 'b.n')}").select("x", "y"), f"{path}-likely")
    ids = likely.selectExpr("explode(array(x, y)) AS k").distinct()
    picked = common.written(classes.join(ids, "k", "left_semi").select("k", "i", "th"), f"{path}-picked")
    texts = rows.join(F.broadcast(picked) if picked.count() <= BROADCAST_SETS else picked, ["i", "th"]).select("k", "t").dropDuplicates(["k"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            maps, beyond = [], []
            for s in found:
                bits = np.zeros(64 * WIDE, dtype=bool)
                bits[s >> np.uint64(20) & np.uint64(64 * WIDE - 1)] = True
                maps.append(np.packbits(bits).view(np.int64))
                beyond.append(len(s) - int(bits.sum()))
            long_lists = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array([s.view(np.int64) for s in found], long_lists), pa.array([len(s) for s in found], pa.int32()), pa.array(maps, long_lists), pa.array(beyond, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "s", "n", "wide", "beyond"])

    common.release(rows.sparkSession)
    whole = common.written(texts.mapInArrow(sets, "k long, s array<long>, n int, wide array<long>, beyond int"), f"{path}-sets")
    # Sets of many shingles fill the trees' bitmaps; wide ones tell most of these pairs apart before whole sets meet.
    side = lambda end: whole.select(F.col("k").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "wide", "beyond")])
    common_bits = F.aggregate(F.zip_with("wide_x", "wide_y", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda a, b: a + b)
    near = likely.join(side("x"), "x").join(side("y"), "y").where((common_bits + F.least("beyond_x", "beyond_y")) >= F.expr(_need("n_x", "n_y")))
    nearer = common.written(near.select("x", "y"), f"{path}-nearer")
    met = nearer.join(whole.selectExpr("k AS x", "s AS sx"), "x").join(whole.selectExpr("k AS y", "s AS sy"), "y")
    shared = met.select("x", "y", F.size(F.array_intersect("sx", "sy")).alias("c"), (F.size("sx") + F.size("sy")).alias("m"))
    found = common.written(shared.where(f"{UP + DOWN} * c >= {UP} * m").select("x", "y"), f"{path}-links")
    for table in ("likely", "picked", "sets", "nearer"):
        common.forget(rows.sparkSession, f"{path}-{table}")
    common.release(rows.sparkSession)
    return found


def _level(below: DataFrame, bits: int) -> DataFrame:
    """The nodes over nodes or entries that agree in the shingle, the size class and the min-hash's lowest bits."""
    facts = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"), F.max("beyond").alias("beyond"), F.min("first").alias("first"), F.max("last").alias("last")]
    return below.groupBy("w", "s", F.col("p").bitwiseAND(F.lit((1 << bits) - 1)).alias("p")).agg(*facts, *[F.bit_or(b).alias(b) for b in BITMAP])


#: SQL: nodes or entries a and b may hold a link between two components.
MAY_LINK = f"""{UP} * a.low <= {DOWN} * b.high AND {UP} * b.low <= {DOWN} * a.high AND NOT (a.first = b.last AND a.last = b.first AND a.first = a.last)
AND least(a.rest, b.rest) >= {_need("a.low", "b.low")} AND {_common_bits("a", "b")} + least(a.beyond, b.beyond) >= {_need("a.low", "b.low")}"""


def traverse(entries: DataFrame, path: str) -> DataFrame:
    """(x, y): the pairs of entries (w, s, p, k and the facts of a node) that the dual traversal of their trees leaves, each once a tree."""
    leaves = common.written(_level(entries, LEVELS[-1]), f"{path}-level-{len(LEVELS) - 1}")
    nodes = [leaves]
    for j in reversed(range(len(LEVELS) - 1)):
        nodes.insert(0, common.written(_level(nodes[0], LEVELS[j]), f"{path}-level-{j}"))
    tops = nodes[0]
    pairs = tops.alias("a").join(tops.alias("b"), F.expr(f"a.w = b.w AND a.s <= b.s AND {MAY_LINK}")).selectExpr("a.w AS w", "a.s AS s1", "a.p AS p1", "b.s AS s2", "b.p AS p2")
    for j, level in enumerate([*nodes[1:], entries], 1):
        up, last = (1 << LEVELS[j - 1]) - 1, level is entries
        order = "a.k < b.k" if last else "a.p <= b.p"
        near = pairs.alias("n").join(level.alias("a"), F.expr(f"a.w = n.w AND a.s = n.s1 AND (a.p & {up}) = n.p1"))
        near = near.join(level.alias("b"), F.expr(f"b.w = n.w AND b.s = n.s2 AND (b.p & {up}) = n.p2 AND (n.s1 < n.s2 OR n.p1 < n.p2 OR {order}) AND {MAY_LINK}"))
        pairs = near.selectExpr("a.k AS x", "b.k AS y") if last else near.selectExpr("a.w AS w", "a.s AS s1", "a.p AS p1", "b.s AS s2", "b.p AS p2")
    return pairs


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its set and the least id that links reach, its own included."""
    spark = docs.sparkSession
    common.ship(spark)
    path = common.workspace(spark)
    text, id = common.text_of(text_col), common.named(id_col).cast("long")
    rows = docs.select(F.coalesce(id, F.lit(NO_ID)).alias("i"), F.xxhash64(text).alias("th"), text.alias("t"))
    marked = common.written(_marked(rows), f"{path}/marked")
    facts = [F.first(c).alias(c) for c in ("n", "prefix", "bitmap", "beyond", "least_hash")]
    grouped = marked.where("n > 0").groupBy("c").agg(F.min(F.struct("i", "th")).alias("one"), F.min(F.when(F.col("i") != NO_ID, F.col("i"))).alias("least"), F.count("*").alias("copies"), *facts)
    # Numbered and written at once: the numbers hold from here on.
    classes = common.written(grouped.select(F.monotonically_increasing_id().alias("k"), "c", "one.i", "one.th", "least", "copies", *[F.col(x) for x in ("n", "prefix", "bitmap", "beyond", "least_hash")]), f"{path}/classes")
    common.release(spark)

    posted = classes.select("k", "n", "copies", F.posexplode("prefix").alias("at", "w"))
    hubs = posted.groupBy("w").agg(F.count("*").alias("sets"), F.max(F.struct("copies", "k", "n", "at")).alias("hub")).where("sets > 1").select("w", "hub", "sets")
    index = common.written(posted.join(hubs, "w").select("k", "n", "at", "w", "sets", F.col("hub.k").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at")), f"{path}/index")
    common.release(spark)
    fits = f"k <> hub AND {_sizes_fit('n', 'hub_n')} AND least(n - at, hub_n - hub_at) >= {_need('n', 'hub_n')}"
    to_hub = index.where(fits).select(F.col("k").alias("x"), F.col("hub").alias("y")).distinct()
    links = _verified(common.written(to_hub, f"{path}/hub-pairs"), rows, classes, f"{path}/hub")

    settled = common.written(components(links.toDF("a", "b")), f"{path}/settled")
    # A hub has met all sets of its trees: the others meet each other, if there are two of them.
    placed = index.where("sets > 2 AND k <> hub").join(settled.withColumnRenamed("node", "k"), "k", "left").select("k", "n", "at", "w", "hub", F.coalesce("component", "k").alias("component"))
    of_hub = settled.select(F.col("node").alias("hub"), F.col("component").alias("of_hub"))
    placed = common.written(placed.join(of_hub, "hub", "left").select("k", "n", "at", "w", "component", (F.col("component") != F.coalesce("of_hub", "hub")).alias("outside")), f"{path}/placed")
    common.forget(spark, f"{path}/index")
    common.release(spark)
    # Trees whose sets are all in the hub's component have nothing left to find.
    growing = placed.where("outside").select("w").distinct()
    about = classes.select("k", "beyond", F.col("least_hash").alias("p"), *[F.col("bitmap")[j].alias(b) for j, b in enumerate(BITMAP)])
    entries = placed.join(growing, "w", "left_semi").join(about, "k").select(
        "w", F.floor(F.log(F.col("n")) / math.log(DOWN / UP)).cast("int").alias("s"), "p", "k", F.col("n").alias("low"), F.col("n").alias("high"),
        (F.col("n") - F.col("at")).alias("rest"), "beyond", F.col("component").alias("first"), F.col("component").alias("last"), *BITMAP,
    )
    found = traverse(common.written(entries, f"{path}/entries"), f"{path}/tree")
    pairs = common.written(found.distinct(), f"{path}/pairs")
    for table in ("placed", "entries", *(f"tree-level-{j}" for j in range(len(LEVELS)))):
        common.forget(spark, f"{path}/{table}")
    common.release(spark)
    more = _verified(pairs, rows, classes, f"{path}/rest")

    linked = components(links.unionByName(more).toDF("a", "b")).select(F.col("node").alias("k"), "component")
    rooted = classes.select("c", "k", "least").join(linked, "k", "left").select("c", "least", F.coalesce("component", "k").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = rooted.join(names, "root").select("c", "component_id")
    own = F.when(F.col("i") != NO_ID, F.col("i"))
    return marked.select("i", "n", "c").join(by_set, "c", "left").select(own.alias("id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"))


def op11_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = {
    "op11_signature_trees": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS x FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = d.doc_id"""
}
