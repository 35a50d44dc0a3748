"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, thresholded by language.

Tokens are words (runs of characters other than space and U+0009 to U+000D). A token's symbol is its hash in SYMBOL_BITS
bits (0 also opens a text), so ORDER symbols and the order fit one 64-bit key, and the table of single symbols has
a bound that no corpus passes; the tables of longer n-grams grow with the trusted text.

Model. The highest order has raw counts, the lower ones the number of different symbols seen before; three discounts for
each order from its counts of counts; each order is interpolated with the next lower one, the lowest with the uniform
distribution over the symbols. Counts, totals, discounted shares and probabilities are Spark joins of sharded tables.

Scoring. The logarithm of an interpolated probability is a sum over the n-grams that end at a token:

    log p(w | context) = base + pred(w) + sum over orders o from 2 of [ctx(context of o) + pred(n-gram of o)]

with ctx the logarithm of what a seen context leaves to the lower order, pred what a seen n-gram adds to that, and 0 for
unseen ones. So each document's n-grams meet the model in one inner join by key, sharded on both sides, and the values
are summed by document. The joins run in PASSES shares of the keys; only one share of the n-grams is shuffled at a time.
Texts become keys in Arrow batches; the values of single symbols, two arrays of 2**SYMBOL_BITS floats, are broadcast.

Thresholds. The model is trained on one half of the trusted documents (by hash of their ids) and the thresholds come from
the other half, which it has not seen, as it has not seen unlabelled text. A short text gives little evidence, so a
document's surprise is shrunk towards its language's median by PRIOR tokens; it is rejected if the shrunk perplexity is
over the language's HIGH quantile times MARGIN. A language with fewer than LEAST held-out documents takes the quantile of
all languages, however few documents there are; without held-out documents nothing is rejected.

Texts without tokens (null, empty, blank) have no perplexity and are kept; null and empty languages are languages of
their own; repeated rows and ties score alike; labels count once a document however often they repeat; an empty table
gives no rows; the row's other columns come back packed, whatever their names. Rows are known by common.numbered, which
holds however a later read is split into tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOL_BITS = 20
ORDER = 2
PASSES = 4
HIGH = 0.99
MARGIN = 1.3
PRIOR = 20
LEAST = 100
#: Ids of so many taught documents at most are broadcast (some 32 MB); beyond that texts and ids meet in a merge join.
BROADCAST_IDS = 2_000_000
MASK = (1 << SYMBOL_BITS) - 1
ORDER_BIT = 3 * SYMBOL_BITS  # up to three orders fit


def symbols(text: bytes | None, order: int) -> np.ndarray:
    """A text's symbols after order - 1 openings: those of Spark's xxhash64."""
    words = (text or b"").split()  # at space and U+0009 to U+000D
    found = np.zeros(order - 1 + len(words), dtype=np.uint64)
    found[order - 1 :] = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words))
    return (found & np.uint64(MASK)).astype(np.int64)


def _texts(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (k, text as bytes), the symbols of all texts, each one's row and place in its text, and the rows' lengths."""
    parts = [symbols(t, order) for t in batch.column(1).to_pylist()]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    row = np.repeat(np.arange(len(parts)), sizes)
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts]), row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row], sizes


def _share(key: str) -> str:
    """SQL: the share of a key, as _grams deals them."""
    bare = f"({key} & {(1 << ORDER_BIT) - 1}L)"
    return f"({bare} ^ shiftright({bare}, {SYMBOL_BITS})) % {PASSES}"


def _grams(rows: DataFrame, order: int, size: int, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """(k, key): the n-grams of a size in rows (k, t) of the share share[0] of share[1] (_share).

    Those of less than the order go from the openings on, with (predicts, opens): the first one is a context alone, the
    last one a prediction alone.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shares = share
        for batch in batches:
            parts = [symbols(t, order) for t in batch.column(1).to_pylist()]
            whole = np.array([k for k, p in enumerate(parts) if len(p) >= order], dtype=np.int64)
            # A shorter n-gram's text begins with one opening less for each symbol that it lacks, but one.
            parts = [p[max(order - size - 1, 0) :] for p in parts if len(p) >= order]
            s = np.concatenate([np.zeros(0, dtype=np.int64), *parts])
            key = s[: max(len(s) - size + 1, 0)]
            for m in range(1, size):
                key = key << SYMBOL_BITS | s[m : m + len(key)]
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            mine = (key ^ key >> SYMBOL_BITS) % shares == of
            for m in range(1, size):  # these run on into the next text
                mine[(ends - m)[ends - m < len(mine)]] = False
            (there,) = np.nonzero(mine)
            columns = [batch.column(0).take(pa.array(whole[np.searchsorted(ends, there, "right")])), pa.array((key | size << ORDER_BIT)[there])]
            if size < order:
                columns += [pa.array(~np.isin(there, np.concatenate([[0], ends[:-1]]))), pa.array(~np.isin(there, ends - size))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "key", "predicts", "opens"][: len(columns)])

    schema = "k long, key long" if size == order else "k long, key long, predicts boolean, opens boolean"
    return rows.select("k", F.col("t").cast("binary")).mapInArrow(each, schema)


def context(key: str, size: int) -> str:
    """SQL: the key of the first size - 1 symbols."""
    return f"({(size - 1) << ORDER_BIT}L | shiftright({key} & {(1 << SYMBOL_BITS * size) - 1}L, {SYMBOL_BITS}))"


def suffix(key: str, size: int) -> str:
    """SQL: the key of the last size - 1 symbols."""
    return f"({(size - 1) << ORDER_BIT}L | ({key} & {(1 << SYMBOL_BITS * (size - 1)) - 1}L))"


def discounts(counted: DataFrame) -> list[float]:
    """D1, D2, D3+ of a table with column n, from its counts of counts; at most n itself, and 0 where they give none."""
    have = {r.n: r.times for r in counted.where("n <= 4").groupBy("n").agg(F.count("*").alias("times")).collect()}
    n1, n2, n3, n4 = (have.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0)
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1)]


class Model:
    """base: log p of a symbol never seen; features: for each size of n-grams (key, pred, ctx), as 32-bit floats."""

    def __init__(self, order: int, base: float, features: dict[int, DataFrame]):
        self.order, self.base, self.features = order, base, features


def train(trusted: DataFrame, path: str, order: int = ORDER) -> Model:
    """trusted: column `text`; order: 2 or 3. Writes the count and feature tables below path."""
    common.ship(trusted.sparkSession)
    keys = _grams(trusted.select(F.lit(0).cast("long").alias("k"), common.text_of("text").alias("t")), order, order)
    counted = {order: common.written(keys.groupBy("key").agg(F.count("*").alias("n")), f"{path}/counts-{order}")}
    for o in range(order, 1, -1):
        counted[o - 1] = common.written(counted[o].groupBy(F.expr(suffix("key", o)).alias("key")).agg(F.count("*").alias("n")), f"{path}/counts-{o - 1}")

    # Order 1: one group.
    d = discounts(counted[1])
    off = lambda d: F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    total, left = counted[1].agg(F.sum("n"), F.sum(off(d))).head()
    spare = max((left or 0.0) / total if total else 1.0, 1e-9) / (1 << SYMBOL_BITS)
    p = counted[1].select("key", ((F.col("n") - off(d)) / F.lit(total or 1) + F.lit(spare)).alias("p"))
    pred, ctx = [p.select("key", (F.log("p") - math.log(spare)).alias("pred"), F.lit(0.0).alias("ctx"))], []
    for o in range(2, order + 1):
        d = discounts(counted[o])
        rows = counted[o].select("key", "n", F.expr(context("key", o)).alias("c"), F.expr(suffix("key", o)).alias("s"))
        totals = rows.groupBy("c").agg(F.sum("n").alias("total"), F.greatest(F.sum(off(d)) / F.sum("n"), F.lit(1e-9)).alias("rest"))
        lower = p.select(F.col("key").alias("s"), F.col("p").alias("low"))
        whole = rows.join(totals, "c").join(lower, "s").select("key", "rest", "low", ((F.col("n") - off(d)) / F.col("total") + F.col("rest") * F.col("low")).alias("p"))
        ctx.append(totals.select(F.col("c").alias("key"), F.lit(0.0).alias("pred"), F.log("rest").alias("ctx")))
        pred.append(whole.select("key", (F.log("p") - F.log("rest") - F.log("low")).alias("pred"), F.lit(0.0).alias("ctx")))
        p = whole.select("key", "p")

    def featured(size: int) -> DataFrame:
        """Predictions of n-grams of a size, and what contexts of that size leave: one row a key, in order of the keys."""
        if size == order:  # one row a key already
            each = pred[size - 1].select("key", F.col("pred").cast("float"), F.col("ctx").cast("float"))
        else:
            each = pred[size - 1].unionByName(ctx[size - 1]).groupBy("key").agg(F.sum("pred").cast("float").alias("pred"), F.sum("ctx").cast("float").alias("ctx"))
        return common.written(each.repartition("key").sortWithinPartitions("key"), f"{path}/features-{size}")

    model = Model(order, math.log(spare), {size: featured(size) for size in range(1, order + 1)})
    for o in counted:
        common.forget(trusted.sparkSession, f"{path}/counts-{o}")
    common.release(trusted.sparkSession)
    return model


def _single(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """pred and ctx of single symbols, by symbol: 2**SYMBOL_BITS numbers each, however large the corpus is."""
    found = features.select(F.col("key").bitwiseAND(F.lit(MASK)).alias("s"), "pred", "ctx").toArrow()
    pred, ctx = np.zeros((2, MASK + 1), dtype=np.float32)
    at = found.column("s").to_numpy()
    pred[at], ctx[at] = found.column("pred").to_numpy(), found.column("ctx").to_numpy()
    return pred, ctx


def surprise(rows: DataFrame, model: Model, path: str) -> DataFrame:
    """(k, n, surprise) of rows (k, t) with tokens: their number, and the sum of -log p over them."""
    order, spark = model.order, rows.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(_single(model.features[1]))

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pred, ctx = shared.value
        for batch in batches:
            s, row, place, sizes = _texts(batch, order)
            # A context is each symbol but the last, and one opening.
            values = np.where(place >= order - 1, pred[s], 0.0) + np.where((place >= order - 2) & (place < sizes[row] - 1), ctx[s], 0.0)
            (there,) = np.nonzero(sizes >= order)
            sums = np.bincount(row, weights=values, minlength=len(sizes))
            columns = [batch.column(0).take(pa.array(there)), pa.array((sizes - order + 1)[there], pa.int32()), pa.array(sums[there])]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n", "v"])

    def met(size: int, of: int) -> DataFrame:
        """(k, n, v): the values of a share of the n-grams of a size. One that opens the next token's n-gram adds its share as a context."""
        # Its keys are distinct, so that no partition of it is large: it is hashed, and the texts' n-grams are not sorted.
        known = model.features[size].where(F.expr(_share("key")) == of)
        each = _grams(rows, order, size, (of, PASSES))
        if size == order:  # only the keys are shuffled, and none is a context
            return each.select("k", "key").join(known.select("key", "pred").hint("shuffle_hash"), "key").select("k", F.lit(None).cast("int").alias("n"), F.col("pred").cast("double").alias("v"))
        value = F.when(F.col("predicts"), F.col("pred")).otherwise(0.0) + F.when(F.col("opens"), F.col("ctx")).otherwise(0.0)
        return each.join(known.hint("shuffle_hash"), "key").select("k", F.lit(None).cast("int").alias("n"), value.cast("double").alias("v"))

    names = [f"{path}/1"]
    rows.select("k", F.col("t").cast("binary")).mapInArrow(singles, "k long, n int, v double").write.parquet(names[0])
    for size in range(2, order + 1):
        for of in range(PASSES):
            names.append(f"{path}/{size}-{of}")
            met(size, of).groupBy("k").agg(F.max("n").alias("n"), F.sum("v").alias("v")).write.parquet(names[-1])
            common.release(spark)
    sums = spark.read.schema("k long, n int, v double").parquet(*names)
    return sums.groupBy("k").agg(F.max("n").alias("n"), (-(F.sum("v") + F.max("n") * F.lit(model.base))).alias("surprise"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic by all of their labels: (_trusted, held_out)."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0")
    return good.select(F.col("doc_id").cast("long").alias("_trusted"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("held_out"))


def thresholds(held_out: DataFrame) -> DataFrame:
    """(lang, middle, most, n): each language's median surprise of a token and the most that a shrunk perplexity may be.

    held_out: (lang, n, surprise). A row of `every` true holds for all languages.
    """
    mean = F.col("surprise") / F.col("n")
    groups = lambda df, *aggs: df.groupBy("lang").agg(*aggs).withColumn("every", F.lit(False)).unionByName(df.groupBy().agg(*aggs).select(F.lit(None).cast("string").alias("lang"), "*", F.lit(True).alias("every")))
    middles = groups(held_out, F.percentile_approx(mean, 0.5, 10_000).alias("middle"), F.count("*").alias("n"))
    apart = F.broadcast(middles.where("NOT every").select(F.col("lang").alias("_lang"), "middle"))
    shrunk = held_out.join(apart, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("shrunk", _shrunk("middle"))
    quantile = groups(shrunk, F.percentile_approx("shrunk", HIGH, 10_000).alias("most")).withColumnRenamed("lang", "_lang").withColumnRenamed("every", "_every")
    both = middles.join(quantile, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("every") == F.col("_every")))
    return both.select("lang", "every", "n", "middle", (F.exp("most") * MARGIN).alias("most"))


def _shrunk(middle: str) -> Column:
    return (F.col("surprise") + PRIOR * F.col(middle)) / (F.col("n") + PRIOR)


def verdicts(docs: DataFrame, labels: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Write and return (k, n, perplexity, shrunk, most, kept) for each row of docs, k its number in common.numbered."""
    rows = common.numbered(docs, {"i": F.col(id_col).cast("long"), "lang": F.col("lang").cast("string"), "t": common.text_of("text")})
    trusted = trusted_ids(labels)
    ids = common.written(trusted.where("NOT held_out").select("_trusted"), f"{path}/taught")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    taught = rows.select("i", "t").join(ids, F.col("i") == F.col("_trusted"), "left_semi").select(F.col("t").alias("text"))
    model = train(taught, f"{path}/model")
    common.release(docs.sparkSession)
    found = surprise(rows.select("k", "t"), model, f"{path}/sums")
    scored = common.written(rows.select("k", "i", "lang").join(found, "k", "left"), f"{path}/scored")
    held = scored.where("n > 0").join(trusted.where("held_out"), F.col("i") == F.col("_trusted"), "left_semi").select("lang", "n", "surprise")
    limits = common.written(thresholds(held), f"{path}/thresholds")
    own = limits.where(f"NOT every AND n >= {LEAST}").select(F.col("lang").alias("_lang"), F.col("middle").alias("own_middle"), F.col("most").alias("own_most"))
    every = limits.where("every").select("middle", "most").head()  # one row, or none
    of_all = [F.lit(x).cast("double") for x in (every or (None, None))]
    judged = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    judged = judged.withColumn("middle", F.coalesce("own_middle", of_all[0])).withColumn("most", F.coalesce("own_most", of_all[1]))
    judged = judged.withColumn("perplexity", F.exp(F.col("surprise") / F.col("n"))).withColumn("shrunk", F.exp(_shrunk("middle")))
    return common.written(judged.select("k", "i", "lang", "n", "perplexity", "shrunk", "most", F.coalesce(F.col("shrunk") <= F.col("most"), F.lit(True)).alias("kept")), f"{path}/verdicts")


def classify(docs: DataFrame, labels: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(row, n_tokens, perplexity, most, kept): row has docs' columns; kept is the verdict."""
    found = verdicts(docs, labels, path, id_col).select("k", F.col("n").alias("n_tokens"), "perplexity", "most", "kept")
    rows = common.numbered(docs, {"row": common.packed(docs)})
    return rows.join(found, "k").select("row", "n_tokens", "perplexity", "most", "kept")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), common.workspace(spark))
    return found.select(F.col("i").alias("doc_id"), "lang", F.coalesce("n", F.lit(0)).cast("long").alias("n_tokens"), F.round("perplexity", 6).alias("perplexity"), F.round("shrunk", 6).alias("shrunk_perplexity"), F.round("most", 6).alias("threshold"), "kept")
