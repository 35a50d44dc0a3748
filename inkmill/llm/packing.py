"""Packing of documents into sequences by non-negative least squares.

A document of n ids gives n // L whole sequences (L the sequence length) and one rest shorter than L. Rests are cut to
whole grains, L being some 64 grains, so that the histogram of their lengths has as many bins, whatever the corpus; what
a cut leaves is shorter than a grain. All combinations of up to DEPTH lengths that fill a sequence exactly are
enumerated; non-negative least squares against the histogram, solved to its optimality conditions, gives their repeat
counts; these are rounded down to what the histogram holds, and the rests take the places so made in the order of their
ranks among rests of their length. The residuals (cut ends, and rests without a place) are packed greedily: laid end to
end and cut at sequence boundaries, so that only the last sequence of all may need padding.

Ranks are counted within each input part and offset by the parts before it, so no length, however common, meets in one
task. The driver gets the histogram, one total for each part and the combinations, never documents.

Null and empty texts are a document of the end id alone; repeated rows are packed as often as they occur; an empty
table gives no pieces; columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .encoding import encoder, forget, vocabulary

LENGTH = 4096
#: Grains of a sequence at least, if its length allows; and lengths in a combination at most.
GRAINS, DEPTH = 64, 8

ENCODED = "part int, at long, doc_id long, n long, whole_before long, rest int, grains int, rest_rank long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def grain_of(length: int) -> int:
    """The largest divisor of length that leaves GRAINS grains or more; 1 for short sequences."""
    return next((g for g in range(length // GRAINS, 1, -1) if length % g == 0), 1)


def combinations(lengths: list[int], total: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of up to depth of the lengths that add up to total; of up to 3 where there are many lengths."""
    lengths, out = sorted(lengths), []
    depth = depth if len(lengths) <= GRAINS else min(depth, 3)

    def extend(chosen: tuple[int, ...], at: int, left: int) -> None:
        if not left:
            out.append(chosen)
        elif len(chosen) < depth:
            for k in range(at, len(lengths)):
                # The rest must fit: the chosen lengths rise, and the last one takes all that is left.
                if lengths[k] == left or 2 * lengths[k] <= left:
                    extend((*chosen, lengths[k]), k, left - lengths[k])

    extend((), 0, total)
    return out


def least_squares(combos: list[tuple[int, ...]], histogram: dict[int, int]) -> np.ndarray:
    """min ||A x - h|| with x >= 0 by active sets; column c of A counts the lengths of combination c.

    Ends when no combination outside of the active set could lessen the error (the conditions of optimality).
    """
    if not combos:
        return np.zeros(0)
    rows = {k: r for r, k in enumerate(sorted(histogram))}
    a = np.zeros((len(rows), len(combos)), dtype=np.float32)
    for c, combo in enumerate(combos):
        for k in combo:
            a[rows[k], c] += 1
    scale = float(max(histogram.values()))
    h = np.array([histogram[k] for k in sorted(histogram)], dtype=np.float64) / scale
    x, active = np.zeros(len(combos)), np.zeros(len(combos), dtype=bool)
    for _ in range(20 * len(rows)):
        slope = a.T @ (h - a[:, active] @ x[active]).astype(np.float32)
        slope[active] = -np.inf
        if slope.max() <= 1e-5:
            break
        active[int(np.argmax(slope))] = True
        while True:
            at = np.flatnonzero(active)
            best = np.linalg.lstsq(a[:, at].astype(np.float64), h, rcond=None)[0]
            if (best > 1e-12).all():
                x[at] = best
                break
            # Go towards the best as far as no count falls below zero; those that reach it leave.
            low = best <= 1e-12
            step = np.min(x[at][low] / np.maximum(x[at][low] - best[low], 1e-300))
            x[at] += step * (best - x[at])
            gone = at[low & (x[at] <= 1e-12)]
            x[gone], active[gone] = 0.0, False
    return x * scale


def repeats(combos: list[tuple[int, ...]], histogram: dict[int, int], x: np.ndarray) -> list[int]:
    """x rounded down, and further so far that no length is used more often than there is."""
    left, out = dict(histogram), []
    for c, v in zip(combos, x, strict=True):
        need = Counter(c)
        n = min([int(v + 1e-9), *(left[k] // m for k, m in need.items())])
        for k, m in need.items():
            left[k] -= n * m
        out.append(n)
    return out


class Plan:
    """Places for ranked rests: rank r among the rests of so many grains -> (sequence, offset), or none beyond the plan."""

    def __init__(self, histogram: dict[int, int], length: int = LENGTH):
        grain = grain_of(length)
        combos = combinations(list(histogram), length // grain)
        counts = repeats(combos, histogram, least_squares(combos, histogram))
        runs: dict[int, list[tuple[int, int, int]]] = {}  # length -> (ranks before, first sequence, offset)
        used: Counter = Counter()
        self.sequences = 0
        for combo, n in zip(combos, counts, strict=True):
            if n:
                at = 0
                for k in combo:
                    runs.setdefault(k, []).append((used[k], self.sequences, at))
                    used[k] += n
                    at += k * grain
                self.sequences += n
        self.used = dict(used)
        self.runs = {k: tuple(np.array(v, dtype=np.int64).T) for k, v in runs.items()}

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets; -1 for rests that the plan has no place for."""
        sequence, offset = np.full(len(lengths), -1, dtype=np.int64), np.full(len(lengths), -1, dtype=np.int64)
        for k in np.unique(lengths):
            if int(k) in self.runs:
                before, first, at = self.runs[int(k)]
                rows = np.flatnonzero((lengths == k) & (ranks < self.used[int(k)]))
                run = np.searchsorted(before, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = first[run] + ranks[rows] - before[run], at[run]
        return sequence, offset


def encode(docs: DataFrame, path: str, vocab_path: str, end_id: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """Write the ids of every whole text with end_id, each document numbered within its part and its rest ranked there."""
    spark = docs.sparkSession
    vocab, grain = spark.sparkContext.broadcast(vocabulary(vocab_path)), grain_of(length)
    out = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("whole_before", pa.int64()), ("rest", pa.int32()), ("grains", pa.int32()), ("rest_rank", pa.int64()), ("ids", pa.binary())])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocab.value), TaskContext.get().partitionId()
        end, at, whole, seen = np.array([end_id], dtype=enc.width).tobytes(), 0, 0, Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = enc.encode(text) + end
                n = len(data) // enc.width.itemsize
                rest = n % length
                rows.append((part, at, doc_id, n, whole, rest, rest // grain, seen[rest // grain], data))
                seen[rest // grain] += 1
                at += 1
                whole += n // length
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out) if rows else pa.RecordBatch.from_pylist([], schema=out)

    return common.written(docs.select(F.col(id_col).cast("long"), common.text_of(text_col)).mapInArrow(ids, ENCODED), path)


def pack(docs: DataFrame, vocab_path: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its document, its place there and its place in a sequence."""
    spark = docs.sparkSession
    common.ship(spark)
    path = common.workspace(spark)
    encoded = encode(docs, f"{path}/ids", vocab_path, end_id, length, id_col, text_col)
    width = np.dtype("<u2") if encoder(vocabulary(vocab_path)).width.itemsize == 2 else np.dtype("<u4")

    # Totals by part: as many rows as the write had tasks.
    totals = {r.part: r.whole for r in encoded.groupBy("part").agg(F.sum(F.expr(f"n div {length}")).alias("whole")).collect()}
    grain = grain_of(length)
    histogram = {r.grains: r.n for r in encoded.where("grains > 0").groupBy("grains").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, length)
    whole_base, wholes = {}, 0
    for part in sorted(totals):
        whole_base[part] = wholes
        wholes += totals[part]

    by_part = encoded.where("rest > 0").groupBy("part", "grains").agg(F.count("*").alias("n"))
    before = by_part.select("part", "grains", (F.sum("n").over(Window.partitionBy("grains").orderBy("part")) - F.col("n")).alias("ranks_before"))
    rests = encoded.select("part", "at", "rest", "grains", "rest_rank").where("rest > 0").join(before, ["part", "grains"])
    ranked = rests.select("part", "at", "rest", "grains", (F.col("rest_rank") + F.col("ranks_before")).alias("rank"))

    shared_plan = spark.sparkContext.broadcast(plan)
    out = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("planned", pa.int32()), ("left", pa.int32()), ("sequence", pa.int64()), ("place", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rest, grains = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            sequence, offset = shared_plan.value.places(grains, batch.column(4).to_numpy())
            planned = np.where(sequence >= 0, grains * grain, 0)
            columns = [pa.array(c) for c in (planned.astype(np.int32), (rest - planned).astype(np.int32), sequence, offset)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], schema=out)

    placed = common.written(ranked.mapInArrow(place, "part int, at long, planned int, left int, sequence long, place long"), f"{path}/placed")

    # Residuals end to end: a running sum within each part, on top of the parts before it.
    base, bases = 0, []
    for r in placed.groupBy("part").agg(F.sum("left").alias("n")).orderBy("part").collect():
        bases.append((r.part, base))
        base += r.n
    bases = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    running = F.sum("left").over(Window.partitionBy("part").orderBy("at")) - F.col("left")
    places = placed.withColumn("run", running).join(bases, "part").select("part", "at", "planned", "sequence", "place", (F.col("base") + F.col("run")).alias("position"))
    joined = encoded.select("part", "at", "doc_id", "whole_before", "ids").join(places, ["part", "at"], "left")
    first_planned, first_left = wholes, wholes + plan.sequences
    shape = pa.schema([(f.name, pa.int64()) for f in spark.createDataFrame([], PIECES).schema])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rows: list[tuple] = []
            for part, _, doc_id, whole, data, planned, sequence, place, position in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(data, dtype=width).astype("<u4")
                n, start = len(ids), 0
                spans = [(whole_base[part] + whole + k, 0, length) for k in range(n // length)]
                left = n % length
                if planned:
                    spans.append((first_planned + sequence, place, planned))
                    left -= planned
                while left:
                    size = min(left, length - position % length)
                    spans.append((first_left + position // length, position % length, size))
                    position, left = position + size, left - size
                for number, at, size in spans:
                    rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, number, at))
                    start += size
            columns = zip(*rows, strict=True) if rows else [[]] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], schema=shape)

    return joined.mapInArrow(cut, PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
