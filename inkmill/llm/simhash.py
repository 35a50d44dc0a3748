"""SimHash near duplicates by covering locality-sensitive hashing.

Fingerprints. A text is lower-cased (A to Z), split into words, and its runs of three words (the whole sequence if
there are fewer) are hashed by XXH64 with seed 42; a bit is 1 if over half of the hashes have it. A text without words
has fingerprint 0, linked like any other.

Links. Fingerprints link at RADIUS = 2 or fewer differing bits. With m(i) a non-zero vector of RADIUS + 1 bits for each
bit i, table v (a non-zero vector too) compares the bits i with <m(i), v> = 1. Any two bits that differ leave a v
orthogonal to both, so every pair within the radius collides in some of the 7 tables: none is lost. Equal fingerprints
are one node. Only fingerprints that share a bucket with another one go on; among them, two are within the radius if
and only if flipping at most one bit of each gives the same number, so all that meet at such a midpoint link to its
least member. That is exact, takes 65 rows for a fingerprint however large its bucket, and lists no pairs in a group.

Null and empty texts have no words; repeated rows share a fingerprint and a component; ties do not arise, components
being named by the least doc_id (null ids do not count; a component of null ids only has a null name); an empty table
gives no rows; columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, near_copies
from .components import components

RADIUS = 2
WINDOW = 3
BITS = 64
#: Hashes turned to bits at a time: bounds the memory that a very long text takes.
BLOCK = 16_384

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < WINDOW:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(WINDOW)), strict=False)))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(shingles), BLOCK):
        hashes = np.array([digest(s, 42) for s in shingles[k : k + BLOCK]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes, as a signed long: the bits that over half of them have."""
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def masks() -> list[int]:
    """The 7 tables' masks: bit i has m(i) = 1 + i mod 7; a mask has the bits with odd <m(i), v>."""
    size = 2 ** (RADIUS + 1)
    return [sum(1 << i for i in range(BITS) if ((1 + i % (size - 1)) & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long."""
    common.ship(docs.sparkSession)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col)).mapInArrow(marks, "id long, fp long")


def _keys() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks())]))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) for distinct fingerprints `fp` of nodes: edges whose components are those of all links within the radius."""
    keyed = nodes.select("fp", _keys().alias("x")).select("fp", "x.v", "x.key")
    shared = keyed.groupBy("v", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("v", "key")
    near = keyed.join(shared, ["v", "key"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    middles = near.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    least = middles.groupBy("middle").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("middle", "least")
    return middles.join(least, "middle").where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the least id that links reach, its own included."""
    path = common.workspace(docs.sparkSession)
    marked = common.written(fingerprints(docs, id_col, text_col), f"{path}/fingerprints")
    nodes = common.written(marked.groupBy("fp").agg(F.min("id").alias("least")), f"{path}/nodes")
    found = components(links(nodes)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are near copies (near_copies.py) of one of a lesser id; of rows that repeat the least id, the first one (by file and place) stays.

    Covering LSH of SimHash fingerprints gives the first candidates; all are verified, and an exact join finds the rest.

    Rows of null ids stay only in components without other ids, one of each.
    """
    rows = common.numbered(docs, {"row": common.packed(docs), "i": F.col(id_col).cast("long"), "t": common.text_of(text_col)})
    # Components of the rows' own numbers; the least (id, number) of each is the one that stays.
    found = near_copies.near_copies(rows.select("k", "t"), majority, links)
    placed = rows.select("k", "i").join(found, "k")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "k")).alias("first")).select(F.col("first.k").alias("k"))
    return rows.join(first, "k", "left_semi").select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
