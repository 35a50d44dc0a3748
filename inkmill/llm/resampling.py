"""Importance resampling towards a target distribution, by hashed n-gram features.

Words are runs of digits, letters and signs beyond ASCII in the text lower-cased from A to Z; features are all runs of one
and two words, with repeats. Each feature has a bucket (CRC-32 of its UTF-8 bytes modulo BUCKETS).

1. Counting. A block of documents (an Arrow batch) has a dictionary of its distinct features: words are numbered by their
   strings, pairs of words by their numbers, and every distinct string is hashed once. Each document's counts by bucket
   are written; their sums by bucket over all documents and over the target are the only thing that is shuffled.
2. Gains. A bucket's gain compares its smoothed shares in the target and in the documents.
3. Scoring. The gains (a table of BUCKETS rows, whatever the corpus) join the written counts; a document's weight is the
   floored mean of its features' gains, its score that weight with Gumbel noise of its id's hash.
4. Drawing. Eligible documents are range-sorted by score over the whole table; a row's rank is its place in its partition
   after the rows of the partitions before. No window holds all rows.

`by_strings` is the same with one dictionary of distinct strings over all documents, as relations; the README says why the
query counts by block.

Null texts have no words; empty ones neither: no features, weight 0, never eligible. A null id hashes as an empty one and
comes last among ties; repeated rows are ranked as often as they occur; ties of score go to the smaller id, then fewer
features, then the lower weight; very long words are hashed like others; empty documents draw nothing, and an empty
target is a target without features. Columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25

#: Each byte lower-cased, or a space if it is in no word.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
COUNTED = "id long, n_words long, n_features long, buckets array<short>, counts array<int>"


def _hashed(words: list[bytes], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of distinct words and of distinct pairs (numbers of both words in one long)."""
    crcs = [zlib.crc32(w) for w in words]
    begun = [zlib.crc32(b" ", c) for c in crcs]  # a pair's hash goes on from its first word's
    first, second = np.divmod(pairs, max(1, len(words)))
    both = [zlib.crc32(words[b], begun[a]) for a, b in zip(first.tolist(), second.tolist(), strict=True)]
    return np.array(crcs, dtype=np.int64) % BUCKETS, np.array(both, dtype=np.int64) % BUCKETS


def count_block(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: each one's words; then, sorted by text and bucket, text number, bucket and count."""
    clean = [t.encode("utf-8", "surrogatepass").translate(_CLEAN) for t in texts]
    data = np.frombuffer(b" ".join([b"", *clean, b""]), dtype=np.uint8)
    inside = data != 32
    edges = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    begins = np.cumsum([1, *(len(c) + 1 for c in clean)])
    n_words = np.diff(np.searchsorted(starts, begins))
    if not len(starts):
        return n_words, *(np.zeros(0, dtype=np.int64),) * 3
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    coded = strings.dictionary_encode()
    numbers, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    of = np.repeat(np.arange(len(texts)), n_words)
    together = of[:-1] == of[1:]
    pairs, pair_numbers = np.unique((numbers[:-1] * len(words) + numbers[1:])[together], return_inverse=True)
    word_buckets, pair_buckets = _hashed(words, pairs)
    keys = np.concatenate([of * BUCKETS + word_buckets[numbers], of[:-1][together] * BUCKETS + pair_buckets[pair_numbers]])
    keys, counts = np.unique(keys, return_counts=True)
    return n_words, *np.divmod(keys, BUCKETS), counts


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COUNTED: each document's words, features and its features' counts by bucket."""
    common.ship(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, of, buckets, counts = count_block(batch.column(1).to_pylist())
            at = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(buckets.astype(np.int16))), pa.ListArray.from_arrays(at, pa.array(counts.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(np.maximum(2 * n_words - 1, 0)), *lists], names=["id", "n_words", "n_features", "buckets", "counts"])

    return docs.select(common.named(id_col).cast("long").alias("id"), common.text_of(text_col)).mapInArrow(blocks, COUNTED)


def totals(found: DataFrame) -> DataFrame:
    """(bucket, n): the features of all documents by bucket; one partial row a bucket and task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            buckets, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(2))
            total += np.bincount(buckets, weights=counts, minlength=BUCKETS).astype(np.int64)  # exact below 2 ** 53
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    return found.select("buckets", "counts").mapInArrow(sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of every bucket from the totals (bucket, n) of the documents and of the target."""
    spark = raw.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    met = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    # Two numbers, whatever the corpus.
    all_s, all_t = (df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n for df in (raw, target))
    ratio = F.expr(f"CAST(t + 1 AS DOUBLE) * CAST({all_s + BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST({all_t + BUCKETS} AS DOUBLE))")
    return met.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(found: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """(id, n_words, n_features, weight): the documents' counts joined with the gains, a table of fixed size."""
    table = np.zeros(BUCKETS, dtype=np.int64)
    for r in by_bucket.collect():
        table[r.bucket] = r.gain
    shared = found.sparkSession.sparkContext.broadcast(table)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(3).offsets.to_numpy(), batch.column(2).to_numpy()
            buckets, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4))
            upto = np.concatenate([[0], np.cumsum(shared.value[buckets] * counts)])
            at = at - at[0]
            weight = (upto[at[1:]] - upto[at[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(weights, "id long, n_words long, n_features long, weight long")


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the SHA-256 of seed and id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (id, n_words, n_features, weight, score) with rank: 1, 2, ... for the best percent of eligible rows, else null."""
    eligible = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    order = [F.desc("score"), F.col("id").asc_nulls_last(), "n_features", "weight"]
    # The last column lets a run of equal rows be cut into several ranges.
    some = scored.where(eligible).withColumn("cut", F.rand(SEED))
    ordered = some.repartitionByRange(*order, "cut").sortWithinPartitions(*order).drop("cut").checkpoint()
    placed = ordered.withColumn("at", F.monotonically_increasing_id())
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # A number for each partition, whatever the number of rows.
    base, bases = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        bases.append((r.part, base))
        base += r.n
    bases = F.broadcast(scored.sparkSession.createDataFrame(bases, "part long, base long"))
    rank = F.col("base") + F.col("place") + 1
    ranked = placed.withColumns({"part": part, "place": place}).join(bases, "part").withColumn("rank", F.when(rank <= percent * base // 100, rank))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each of docs: id, n_words, n_features, weight, score, rank (null where not drawn)."""
    path = common.workspace(docs.sparkSession)
    found = common.written(counted(docs, id_col, text_col), f"{path}/counted")
    wanted = counted(target.select(F.lit(0).alias("k"), common.text_of(target_text).alias("t")), "k", "t")
    by_bucket = gains(totals(found), totals(wanted))
    scored = weighed(found, by_bucket).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return drawn(common.written(scored, f"{path}/scored"), percent, min_words)


def _strings(docs: DataFrame, text_col: str) -> DataFrame:
    """(k, feature, n): each row's distinct features by their strings."""
    text = F.translate(common.text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select("k", F.array_remove(F.split(text, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "").alias("w"))
    both = F.concat("w", F.expr("transform(slice(w, 2, greatest(size(w) - 1, 0)), (x, i) -> concat(w[i], ' ', x))"))
    return words.select("k", F.explode(both).alias("feature")).groupBy("k", "feature").agg(F.count("*").alias("n"))


def by_strings(docs: DataFrame, target: DataFrame, key: str = "k", text_col: str = "text") -> DataFrame:
    """(k, weight) by one dictionary of distinct strings: counted over all documents, hashed once each, joined back."""
    bucket = (F.crc32(F.col("feature").cast("binary")) % BUCKETS).cast("int").alias("bucket")
    features = _strings(docs.withColumn("k", common.named(key)), text_col)
    dictionary = features.groupBy("feature").agg(F.sum("n").alias("n")).select("feature", "n", bucket)
    wanted = _strings(target.select(F.lit(0).alias("k"), common.named(text_col)), text_col).select(bucket, "n")
    by_bucket = gains(dictionary.groupBy("bucket").agg(F.sum("n").alias("n")), wanted.groupBy("bucket").agg(F.sum("n").alias("n")))
    known = dictionary.join(F.broadcast(by_bucket), "bucket").select("feature", "gain")
    met = features.join(known, "feature").groupBy("k").agg(F.floor(F.sum(F.col("n") * F.col("gain")) / F.sum("n")).cast("long").alias("weight"))
    return docs.select(common.named(key).alias("k")).join(met, "k", "left").fillna(0, ["weight"])


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_FEATURES = """SELECT {key}, CASE WHEN i < len(w) THEN w[i + 1] ELSE w[i - len(w) + 1] || ' ' || w[i - len(w) + 2] END AS f
FROM (SELECT {key}, w, unnest(range(greatest(2 * len(w) - 1, 0))) AS i FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}))"""

#: crc32 of distinct strings by a table of 256 entries, over the hexadecimal digits of their bytes.
SQL = {
    "op13_resampling": f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(b, CAST(range(8) AS BIGINT[])), lambda s, i: xor(s >> 1, 3988292384 * (s & 1))) ORDER BY b) AS tab FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
d AS ({_FEATURES.format(key="doc_id", table="documents")}), g AS ({_FEATURES.format(key="item_id", table="benchmark")}),
strings AS (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM g)),
bytes AS (SELECT f, tab, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || hex(encode(f))[2 * i + 1:2 * i + 2] AS BIGINT)) AS codes FROM strings, crc),
hashed AS (SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM bytes),
s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM d JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM documents LEFT JOIN weights USING (doc_id)),
eligible AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {2 * MIN_WORDS - 1})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM eligible
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {2 * MIN_WORDS - 1}"""
}
