"""Near copies among documents: an exact similarity join on five-word shingles, Jaccard 0.8 or more.

A text is lower-cased (A to Z) and split into words; its set is that of its runs of five words (the whole sequence if
there are fewer), each as 56 bits of its XXH64 hash. Texts without words have the empty set and are alike.

1. Equal sets collapse to one node (key: two 64-bit hashes of the sorted set).
   Sets whose SimHash fingerprints meet in covering LSH (simhash.links) are candidates; those that hold on the whole sets are
   the first links. Fingerprints of sets at 0.8 may differ in more bits than any covering code affords, so the rest is exact:
2. Shingles are ordered by rarity: those seen more than once in a sample of the texts come last, by their counts. The
   sample decides the order only; any total order gives exact results.
3. Prefix filter: sets within the threshold share a shingle among their first n - ceil(0.8 n) + 1. Sets meet on those,
   with the length and the positional filter. Shingles in one prefix only go before anything else.
4. First each set meets only its shingles' hubs (the most copied set), where SimHash has not linked both: a large group of near copies settles in as many
   meetings as it has sets. Then the sets outside of the hub's component meet the sets of other components, so that a
   component's own pairs are never listed.
5. Pairs are verified on the whole sets; those that hold are links.

No pair at or over the threshold is lost: each is verified, or lies within one component already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

WINDOW = 5
#: Jaccard threshold as a fraction.
UP, DOWN = 4, 5
#: One text in so many is looked at for the order of the shingles; so many common ones are told apart at most.
SAMPLE, COMMON = 32, 131_072
LOW = (1 << 56) - 1
#: The index is dealt by shingle in so many passes, each of which has its share on disk alone.
PASSES = 2
#: Texts of so many pairs at most are picked by a broadcast of their ids.
BROADCAST_PAIRS = 1_000_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingles of a whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    runs = [b" ".join(words)] if len(words) < WINDOW else map(b" ".join, zip(*(words[k:] for k in range(WINDOW)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(s, 42) & LOW for s in runs}), dtype=np.int64)


def prefix_size(n: int) -> int:
    return n - (n * UP + DOWN - 1) // DOWN + 1 if n else 0


def _sampled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order, and their rarity classes (1 to 127)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text))], names=["w"])

    some = rows.where(F.pmod(F.xxhash64("k"), F.lit(SAMPLE)) == 0).select("t").mapInArrow(each, "w long")
    found = some.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(COMMON).toArrow()
    # Columns, not a hundred thousand rows of Python objects, come to the driver.
    words, counts = (found.column(c).to_numpy() for c in ("w", "n"))
    order = np.argsort(words)
    return words[order], np.array([min(127, int(3 * math.log2(n))) for n in counts[order].tolist()], dtype=np.int64)


def _marked(rows: DataFrame, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """(k, h1, h2, n, prefix, fp): each row's set by its hash, its size, its rarest shingles in order and its fingerprint."""
    shared = rows.sparkSession.sparkContext.broadcast(_sampled(rows))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_, classes = shared.value
        for batch in batches:
            h1, h2, sizes, prefixes, fps = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                data = s.tobytes()
                h1.append(xxhash.xxh64_intdigest(data, 1) - (1 << 63))
                h2.append(xxhash.xxh64_intdigest(data, 2) - (1 << 63))
                sizes.append(len(s))
                fps.append(fingerprint(s))
                keys = s
                if len(common_) and len(s):
                    at = np.minimum(np.searchsorted(common_, s), len(common_) - 1)
                    keys = np.sort(s | np.where(common_[at] == s, classes[at], 0) << 56)
                prefixes.append(keys[: prefix_size(len(s))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["k", "h1", "h2", "n", "prefix", "fp"])

    return rows.select("k", "t").mapInArrow(marks, "k long, h1 long, h2 long, n int, prefix array<long>, fp long")


def _may_match(a: str, b: str) -> str:
    """SQL: the length and positional filters for index entries a and b of one shingle."""
    need = f"(({UP} * ({a}.n + {b}.n) + {UP + DOWN - 1}) div {UP + DOWN})"
    return f"{a}.n * {UP} <= {b}.n * {DOWN} AND {b}.n * {UP} <= {a}.n * {DOWN} AND least({a}.n - {a}.at, {b}.n - {b}.at) >= {need}"


def _verified(pairs: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """The pairs (x, y) whose whole sets are similar enough, written."""
    ids = pairs.selectExpr("explode(array(x, y)) AS k").distinct()
    picked = rows.select("k", "t").join(F.broadcast(ids) if pairs.count() <= BROADCAST_PAIRS else ids, "k", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["k", "s"])

    whole = common.written(picked.mapInArrow(sets, "k long, s array<long>"), f"{path}-sets")
    both = pairs.join(whole.selectExpr("k AS x", "s AS sx"), "x").join(whole.selectExpr("k AS y", "s AS sy"), "y")
    shared = both.select("x", "y", F.size(F.array_intersect("sx", "sy")).alias("c"), (F.size("sx") + F.size("sy")).alias("m"))
    links = common.written(shared.where(f"{UP + DOWN} * c >= {UP} * m").select("x", "y"), f"{path}-links")
    common.forget(rows.sparkSession, f"{path}-sets")
    return links


def _by_fingerprint(reps: DataFrame, links: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """(x, y): sets (id, fp) of one fingerprint with the least of them, and those least ones of fingerprints that links joins."""
    heads = common.written(reps.groupBy("fp").agg(F.min("id").alias("head")), f"{path}/fingerprints")
    same = reps.join(heads, "fp").where("id <> head").select(F.col("id").alias("x"), F.col("head").alias("y"))
    ends = links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return common.written(same.unionByName(ends.select("x", "y")), f"{path}/fingerprint-pairs")


def near_copies(rows: DataFrame, fingerprint: Callable[[np.ndarray], int], links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k, component) for rows (k, t): component is the least k that links reach, the row's own included.

    k is a long without repeats and t a text without nulls; rows is read several times and must be the same each time.
    fingerprint: a set's SimHash as a signed long; links_of: (a, b), the fingerprints `fp` of a table that are near.
    """
    spark = rows.sparkSession
    common.ship(spark)
    path = common.workspace(spark)
    marked = common.written(_marked(rows, fingerprint), f"{path}/marked")
    nodes = common.written(marked.groupBy("h1", "h2").agg(F.min("k").alias("id"), F.count("*").alias("copies")), f"{path}/nodes")
    reps = marked.where("n > 0").select(F.col("k").alias("id"), "n", "prefix", "fp").join(nodes.select("id", "copies"), "id")
    alike = _verified(_by_fingerprint(reps.select("id", "fp"), links_of, path), rows, f"{path}/fingerprint")
    joined = common.written(components(alike.toDF("a", "b")), f"{path}/joined")
    common.release(spark)
    by_word = Window.partitionBy("word")
    for of in range(PASSES):
        index = reps.select("id", "n", "copies", F.posexplode("prefix").alias("at", "word")).where(F.pmod(F.col("word"), F.lit(PASSES)) == of)
        hub = F.max(F.struct("copies", "id", "n", "at")).over(by_word).alias("hub")
        met = index.select("id", "n", "copies", "at", "word", hub, F.count("*").over(by_word).alias("sets")).where("sets > 1").drop("sets")
        common.written(met, f"{path}/index-{of}")
        common.release(spark)
    index = spark.read.schema(met.schema).parquet(*[f"{path}/index-{of}" for of in range(PASSES)])
    to_hub = index.alias("a").where(f"a.id <> hub.id AND {_may_match('a', 'hub')}").select(F.col("id").alias("x"), F.col("hub.id").alias("y")).distinct()
    for end in ("x", "y"):
        to_hub = to_hub.join(joined.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    to_hub = to_hub.where("coalesce(of_x, x) <> coalesce(of_y, y)").select("x", "y")
    links = alike.unionByName(_verified(common.written(to_hub, f"{path}/hub-pairs"), rows, f"{path}/hub"))

    settled = common.written(components(links.toDF("a", "b")), f"{path}/settled")
    placed = index.join(settled.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "at", "word", "hub", F.coalesce("component", "id").alias("component"))
    # A pair of two components has a member that is not in the component of its shingle's hub.
    hubs = settled.select(F.col("node").alias("h"), F.col("component").alias("of_hub"))
    outside = placed.join(hubs, F.col("hub.id") == F.col("h"), "left").where("component <> coalesce(of_hub, hub.id)").select("id", "n", "at", "word", "component")
    cross = outside.alias("a").join(placed.alias("b"), F.expr(f"a.word = b.word AND a.component <> b.component AND {_may_match('a', 'b')}"))
    pairs = common.written(cross.select(F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y")).distinct(), f"{path}/pairs")
    more = _verified(pairs, rows, f"{path}/rest")

    found = components(links.unionByName(more).toDF("a", "b")).select(F.col("node").alias("id"), "component")
    by_set = nodes.join(found, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    return marked.select("k", "h1", "h2").join(by_set, ["h1", "h2"]).select("k", "component")
