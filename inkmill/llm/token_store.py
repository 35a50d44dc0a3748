"""Token ids in a compressed store with short-document access.

Format. A store is a folder with three Parquet tables: `shards` (one row a shard), `dictionary` (one row) and
`vocabulary width` inside each shard's header. A shard's `data` is

    4 bytes   magic "IKT1"
    4 bytes   unsigned: bytes of an id (2 or 4)
    32 bytes  SHA-256 of the shared zstandard dictionary (zeros: none)
    8 bytes   unsigned: documents in the shard
    index     for each document 8 + 8 + 4 + 8 bytes: doc_id (signed; the least 64-bit number for null), offset of its
              frame, bytes of its frame, ids in it
    frames    a zstandard frame for each document, compressed on its own with the shared dictionary

so that one document is read by its index entry, without inflating its neighbours. Documents lie in ascending order of
doc_id (nulls first) through partitions, shards and frames.

Null and empty texts become a document with the end id alone; repeated rows are stored as often as they occur, ties
side by side; an empty table gives a store without shards; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, vocabulary

MAGIC = b"IKT1"
HEAD = struct.Struct("<4sI32sQ")
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u8")])
NO_ID = -(2**63)

SHARD_BYTES = 4 << 20
SHARD_DOCS = 65_536
DICTIONARY_BYTES = 32 << 10
#: The dictionary is trained on about so many documents, at most twice as many, chosen by the hashes of their ids and texts.
DICTIONARY_DOCS = 512
#: Of each, the dictionary sees the ids' first so many bytes.
SAMPLE_BYTES = 32 << 10
LEVEL = 3

SHARDS = "part int, shard int, first_id long, last_id long, n_docs long, start long, n_ids long, dictionary_sha256 string, data binary"
FOUND = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long, frame_bytes long"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; the samples' own bytes where they are too few to train on, none without samples."""
    samples = [s for s in samples if len(s) >= 8]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    """Collects documents, in order, into shards of bounded size."""

    def __init__(self, width: np.dtype, dictionary: bytes):
        self.width, self.sha = width, hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_as_dictionary(dictionary)).compress
        self.shard = self.start = 0
        self._clear()

    def _clear(self) -> None:
        self.entries, self.frames, self.size, self.n_ids = [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> dict | None:
        frame = self.compress(ids)
        self.entries.append((NO_ID if doc_id is None else doc_id, self.size, len(frame), len(ids) // self.width.itemsize))
        self.frames.append(frame)
        self.size += len(frame)
        self.n_ids += len(ids) // self.width.itemsize
        return self.close() if self.size >= SHARD_BYTES or len(self.frames) >= SHARD_DOCS else None

    def close(self) -> dict | None:
        if not self.frames:
            return None
        index = np.array(self.entries, dtype=ENTRY)
        head = HEAD.pack(MAGIC, self.width.itemsize, self.sha, len(index))
        ids = [None if e[0] == NO_ID else e[0] for e in (self.entries[0], self.entries[-1])]
        row = {"shard": self.shard, "first_id": ids[0], "last_id": ids[1], "n_docs": len(index), "start": self.start, "n_ids": self.n_ids, "dictionary_sha256": self.sha.hex(), "data": b"".join([head, index.tobytes(), *self.frames])}
        self.shard += 1
        self.start += self.n_ids
        self._clear()
        return row


class ShardReader:
    """The index of one shard, and its documents by position."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, item, sha, n = HEAD.unpack_from(data)
        if magic != MAGIC or sha != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError("not a shard of this store: magic or dictionary hash differs")
        self.width = np.dtype(f"<u{item}")
        self.index = np.frombuffer(data, dtype=ENTRY, count=n, offset=HEAD.size)
        self.data, self.base = data, HEAD.size + n * ENTRY.itemsize
        self.decompress = zstandard.ZstdDecompressor(dict_data=_as_dictionary(dictionary)).decompress

    def ids(self, k: int) -> np.ndarray:
        """The ids of document k alone."""
        e = self.index[k]
        at = self.base + int(e["offset"])
        frame = self.data[at : at + int(e["length"])]
        return np.frombuffer(self.decompress(frame), dtype=self.width)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def write(docs: DataFrame, path: str, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write the store below path."""
    spark = docs.sparkSession
    common.ship(spark)
    vocab = spark.sparkContext.broadcast(vocabulary(vocab_path))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), common.text_of(text_col).alias("t"))
    # About DICTIONARY_DOCS rows, chosen by the hashes of their ids and texts; the driver gets SAMPLE_BYTES of each at most.
    one_in = max(1, docs.count() // DICTIONARY_DOCS)
    chosen = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(one_in)) == 0).limit(2 * DICTIONARY_DOCS)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([enc.encode(t)[:SAMPLE_BYTES] for t in batch.column(0).to_pylist()], type=pa.binary())], names=["ids"])

    dictionary = dictionary_of(sorted(bytes(r.ids) for r in chosen.select("t").mapInArrow(heads, "ids binary").collect()))
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    out = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("dictionary_sha256", pa.string()), ("data", pa.binary())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocab.value), TaskContext.get().partitionId()
        writer, end = ShardWriter(enc.width, dictionary), np.array([end_id], dtype=enc.width).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if full := writer.add(doc_id, enc.encode(text) + end):
                    yield _batch([{"part": part, **full}], out)
        if last := writer.close():
            yield _batch([{"part": part, **last}], out)

    # Ranges of id and text: the rows of one id, or of none, need not lie in one task.
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("i", "h").sortWithinPartitions("i", "h").select("i", "t")
    ordered.mapInArrow(shards, SHARDS).write.option("compression", "uncompressed").parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored document, from the files: doc_id, start, n_tokens, ids_crc32, frame_bytes."""
    common.ship(spark)
    dictionary = bytes(spark.read.schema("sha256 string, dictionary binary").parquet(f"{path}/dictionary").head().dictionary)
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    # Partitions are as many as the write had tasks, whatever the number of documents.
    base, bases = 0, []
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((r.part, base))
        base += r.n
    bases = F.broadcast(spark.createDataFrame(bases, "part int, part_start long"))
    out = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("frame_bytes", pa.int64())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, data = (batch.column(c)[k].as_py() for c in range(3))
                shard = ShardReader(data, dictionary)
                crcs = [zlib.crc32(shard.ids(j).astype("<u4").tobytes()) for j in range(len(shard.index))]
                n = shard.index["n_ids"].astype(np.int64)
                ids = shard.index["doc_id"]
                columns = [
                    pa.array(np.full(len(n), part, dtype=np.int32)),
                    pa.array(ids, mask=ids == NO_ID),
                    pa.array(start + np.cumsum(n) - n),
                    pa.array(n),
                    pa.array(crcs, type=pa.int64()),
                    pa.array(shard.index["length"].astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    found = shards.select("part", "start", "data").mapInArrow(documents, FOUND)
    return found.join(bases, "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "frame_bytes")


def document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id, inflating no others: shards are chosen by their id range, frames by the index."""
    dictionary = bytes(spark.read.schema("sha256 string, dictionary binary").parquet(f"{path}/dictionary").head().dictionary)
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards").where((F.coalesce("first_id", F.lit(NO_ID)) <= doc_id) & (F.col("last_id") >= doc_id))
    out = []
    for row in shards.orderBy("part", "shard").select("data").toLocalIterator():
        shard = ShardReader(bytes(row.data), dictionary)
        out += [shard.ids(int(k)).tolist() for k in np.flatnonzero(shard.index["doc_id"] == doc_id)]
    return out


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{common.workspace(spark)}/tokens"
    write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read(spark, path)
