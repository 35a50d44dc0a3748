import hashlib
import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def slow_resample(docs, target):
    s, t = (Counter(bucket(f) for x in texts for f in slow_features(x)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for d, x in docs:
        words, fs = slow_features(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(str((*r, rank.get(id(r)))) for r in rows)


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAzZ09é漢 \n\t.-\x00\x7f", max_size=40), max_size=6))
def test_blocks_count_as_documents_do(texts):
    n_words, of, buckets, counts = resampling.count_block(texts)
    for k, t in enumerate(texts):
        words, fs = slow_features(t)
        assert n_words[k] == len(words)
        assert dict(zip(buckets[of == k].tolist(), counts[of == k].tolist(), strict=True)) == Counter(map(bucket, fs))


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    want = slow_resample(docs, target)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(resampling.resample(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))) == want
    query = resampling.op13_resampling(spark, sf_dir)
    assert [f.dataType.simpleString() for f in query.schema] == ["bigint"] * 5 and query.count() == len(docs)


def test_dictionary_of_strings_gives_the_same_weights(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = {r.k: r.weight for r in resampling.by_strings(docs, target, "doc_id").collect()}
    assert plain == {r.id: r.weight for r in resampling.resample(docs, target).collect()}


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert got(resampling.resample(edges, edges)) == slow_resample(rows, [t for _, t in rows])
    assert got(resampling.resample(edges, nothing)) == slow_resample(rows, [])
    assert resampling.resample(nothing, edges).count() == 0


def test_ties_and_repeated_rows_are_ranked_once_each(spark):
    text = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(k % 3, text) for k in range(40)], "doc_id long, text string").repartition(5)
    rows = resampling.resample(docs, docs).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 11)) and len(rows) == 40
    assert len({r.score for r in rows if r["rank"]}) == 1
