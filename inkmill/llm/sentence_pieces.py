"""SentencePiece encoding and decoding.

`lattice` is the relational one: each distinct word explodes into its substrings of bounded length, an equi-join with the
piece table leaves the lattice's edges, edges are grouped by word, and a higher-order aggregate folds them: by Viterbi for
piece tables with additive scores (unigram models), or by merges in the order of the scores (BPE models), which gives the
library's pieces for BPE. Characters that no piece covers become one edge with the score UNKNOWN.

`encode`, which the query runs, is for the byte-fallback BPE model at hand and whole texts: it merges with the library
itself, once for each unit of a worker's bounded cache. The lattice of all distinct words does not fit the query's limits
(the README has the measured figures). A unit is a run of spaces with the characters up to the next space; no piece of
the vocabulary goes on from another sign into a space (tested when a model is loaded; otherwise whole texts are encoded),
so units are independent.

Null and empty texts have no ids; repeated rows and ties encode alike; an empty table gives no rows; columns other than
the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
UNITS = re.compile(" *[^ ]+| +")
CACHE_UNITS = 220_000
UNKNOWN = -100.0


class Encoder:
    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.by_unit = apart and self.library.encode("a  b") == self.library.encode("a") + self.library.encode(" b")
        self.units: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            # The library opens each text with a space of its own.
            ids = self.library.encode(unit[1:]) if len(unit) > 1 else [self.library.piece_to_id(SPACE)]
            found = array("i", ids).tobytes()
        if len(self.units) >= CACHE_UNITS:
            self.old, self.units = self.units, {}
        self.units[unit] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not text or not self.by_unit or SPACE in text:
            return np.array(self.library.encode(text), dtype=np.int32)
        out, units = [], self.units
        for unit in UNITS.findall(" " + text):
            found = units.get(unit)
            if found is None:
                found, units = self._unit(unit), self.units
            out.append(found)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_encoders: dict[int, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    key = zlib.crc32(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids): the ids of every whole text as little-endian 32-bit integers."""
    spark = docs.sparkSession
    common.ship(spark)
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())  # the size of the model file

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            found = pa.array([enc.encode(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["id", "text", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text")).mapInArrow(ids, "id long, text string, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(id, text, ids, decoded): the text of the ids."""
    spark = encoded.sparkSession
    common.ship(spark)
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value)
        for batch in batches:
            found = pa.array([enc.decode(np.frombuffer(b.as_py(), dtype="<i4")) for b in batch.column(2)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["id", "text", "ids", "decoded"])

    return encoded.select("id", "text", "ids").mapInArrow(texts, "id long, text string, ids binary, decoded string")


def edges_of(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, edges): for each distinct word its sorted edges (end, order, size, score), a piece's score or UNKNOWN for a sign that is none."""
    longest = pieces.agg(F.max(F.length("piece"))).head()[0] or 1
    distinct = words.where(F.length("word") > 0).select("word").distinct()
    spans = distinct.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")).select(
        "word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("size")
    )
    cut = spans.select("word", "at", "size", F.substring("word", F.col("at"), F.col("size")).alias("piece"))
    known = pieces.groupBy("piece").agg(F.max("score").cast("double").alias("score"))
    edges = cut.join(known, "piece", "left").where("score IS NOT NULL OR size = 1").withColumn("score", F.coalesce("score", F.lit(UNKNOWN)))
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct((F.col("at") + F.col("size") - 1).alias("end"), (-F.col("size")).alias("order"), "size", "score"))).alias("edges"))


def merged(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, pieces): each distinct `word` by BPE: of all neighbours that make a piece, those of the best score merge, the leftmost first.

    pieces is a vocabulary of fixed size (`piece`, `score`); words of null or of no characters have no row.
    """
    several = F.filter("edges", lambda e: e["size"] > 1)
    table = F.map_from_entries(F.array_distinct(F.transform(several, lambda e: F.struct(F.substring(F.col("word"), e["end"] - e["size"] + 1, e["size"]).alias("piece"), e["score"]))))
    # Of the places i whose two pieces make a known one: the best score, and the least i of it.
    best = "array_max(filter(transform(sequence(0, size(p) - 2), i -> struct(try_element_at(known, p[i] || p[i + 1]) AS score, -i AS i)), x -> x.score IS NOT NULL))"
    join = "concat(slice(p, 1, -b.i), array(p[-b.i] || p[1 - b.i]), slice(p, 3 - b.i, size(p)))"
    step = f"CASE WHEN size(p) < 2 THEN p ELSE element_at(transform(array({best}), b -> CASE WHEN b IS NULL THEN p ELSE {join} END), 1) END"
    fold = f"aggregate(sequence(1, length(word)), transform(sequence(1, length(word)), i -> substring(word, i, 1)), (p, n) -> {step})"
    return edges_of(words, pieces).withColumn("known", table).select("word", F.expr(fold).alias("pieces"))


def lattice(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, pieces, score): the best segmentation of each distinct `word` by pieces (`piece`, `score`).

    pieces is a vocabulary of fixed size; words of null or of no characters have no row. Ties go to the segmentation
    whose last piece is the longest.
    """
    grouped = edges_of(words, pieces)
    # best[k]: the best path's score and last piece's size, over the first k characters
    fold = """
        aggregate(edges, array(struct(cast(0 AS double) AS score, 0 AS size)), (best, e) ->
            CASE WHEN size(best) = e.end THEN concat(best, array(struct(best[e.end - e.size].score + e.score AS score, e.size AS size)))
                 WHEN best[e.end - e.size].score + e.score > best[e.end].score
                 THEN concat(slice(best, 1, e.end), array(struct(best[e.end - e.size].score + e.score AS score, e.size AS size)))
                 ELSE best END)
    """
    best = grouped.select("word", F.expr(fold).alias("best"))
    back = """
        aggregate(sequence(1, length(word)), struct(length(word) AS at, cast(array() AS array<string>) AS out), (a, i) ->
            CASE WHEN a.at > 0 THEN struct(a.at - best[a.at].size AS at, concat(array(substring(word, a.at - best[a.at].size + 1, best[a.at].size)), a.out) AS out) ELSE a END).out
    """
    return best.select("word", F.expr(back).alias("pieces"), F.element_at("best", -1)["score"].alias("score"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids of the whole text, their checksum, and whether they decode to the text again."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = decode(encode(common.table(spark, sf_dir, "documents"), path), path)
    return found.select(F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"))
