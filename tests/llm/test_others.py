import hashlib
import math
import os
import re
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpus_pipeline
from inkmill.llm import common, compaction, kneser_ney, media, pii, quality_rules, sentence_pieces

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(BASE) for m in re.finditer(rx, text) if ok(m[0]))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)


ODD = ["a@b.c_d@e.f", "x@@y.z a.b+c@d-e.f-g.h", "1.2.3.4.5.6.7.8", "1.2.3.4567 001.002.003.255", "4111 1111 1111 1111", "4111-1111-1111-11112", "9 4111111111111111", "+1 (523) 555-1055 +12345678 +1234567890123456", "é 😀 a@b.co 8.8.8.8", "4111111111111111 4111111111111111", "1-1 +1", "", "@" * 30, "1" * 300, "a" * 3000 + "@", "+" * 20 + "1 2", "12.34.56 7.8.9.10.", "a@b.c@d.e"]


def test_base_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    found = pii.find(rows, ["doc_id"]).select("row.doc_id", pii.written_spans("base").alias("b")).collect()
    assert {r.doc_id: r.b for r in found} == {k: base_spans(t) for k, t in enumerate(ODD)}


def test_base_over_the_table(spark, sf_dir, texts):
    rows = pii.op3_pii(spark, sf_dir).collect()
    assert {r.doc_id: r.base_sha256 for r in rows} == {k: hashlib.sha256(base_spans(t).encode()).hexdigest() for k, t in texts.items()}
    assert all(set(base_spans(texts[r.doc_id]).split(",")) - {""} <= set(r.spans.split(",")) for r in rows)


def test_bootstrap_finds_what_the_base_misses(spark, tmp_path):
    rows = [(k, f"the server 10.0.{k}.{k} is up") for k in range(30)] + [(100, "the server 10.0.300.1 is up"), (101, "version 10.0.300.1 is out"), (102, "no data")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    found = {r.doc_id: r.s for r in pii.find(spark.read.parquet(f"{tmp_path}/d"), ["doc_id"]).select("row.doc_id", pii.written_spans("spans").alias("s")).collect()}
    assert found[100] == "ip:11:21" and found[101] == found[102] == ""


def test_redact(edges, nothing):
    out = pii.redact(edges)
    assert out.columns == edges.columns
    rows = out.collect()
    assert [r.text for r in rows if r.doc_id is None] == ["A row without an id, mail [EMAIL] now."]
    assert len(rows) == 9 and [r.text for r in rows if r.doc_id == 2] == [None] and pii.redact(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=700), st.sampled_from([(0,), (0, 1, 2), (2,), (1,), (3,), (4,), (4, 3, 2, 1, 0), media.FILTERS]))
def test_png_round_trip(data, filters):
    padded = media.payload(data)
    assert len(padded) % 64 == 0 and padded[: len(data)] == data and len(padded) > 0
    assert media.read_png(media.write_png(padded, filters)).tobytes() == padded


def slow_unfilter(raw):
    """Sample by sample, by the format's rules."""
    out = np.zeros((len(raw), raw.shape[1] - 1), dtype=np.uint8)
    for y, row in enumerate(raw.tolist()):
        for x, v in enumerate(row[1:]):
            a, b, c = int(out[y, x - 1]) if x else 0, int(out[y - 1, x]) if y else 0, int(out[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            out[y, x] = (v + (0, a, b, (a + b) // 2, paeth)[row[0]]) & 255
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=9), min_size=1, max_size=4), st.integers(1, 9), st.integers(0, 1 << 30))
def test_unfilter_against_brute_force(kinds, width, seed):
    images = []
    for k, each in enumerate(kinds):
        raw = np.random.default_rng(seed + k).integers(0, 256, (len(each), width + 1), dtype=np.uint8)
        raw[:, 0] = each
        images.append(raw)
    for raw in images:
        assert (media.unfilter(raw) == slow_unfilter(raw)).all()
    whole = [x for x in images if len(x)]
    if whole:
        first = np.concatenate([np.arange(len(x)) == 0 for x in whole])
        assert (media.unfilter(np.concatenate(whole), first) == np.concatenate([slow_unfilter(x) for x in whole])).all()


def test_images_of_a_batch(tmp_path):
    data = [media.payload(bytes([k] * n)) for k, n in enumerate((0, 1, 64, 65, 5000, 640))]
    assert [x.tobytes() for x in media.read_all([media.write_png(d) for d in data])] == data and media.read_all([]) == []


@pytest.mark.parametrize("spoil", [lambda p: p[:-1], lambda p: p[:40] + bytes([p[40] ^ 1]) + p[41:], lambda p: b"x" + p[1:], lambda p: p[:33]])
def test_png_tests(spoil):
    with pytest.raises((ValueError, zlib.error)):
        media.read_png(spoil(media.write_png(media.payload(b"some text"))))


def test_media_against_brute_force(spark, sf_dir, texts):
    rows = media.op7_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert len(r.feature) == 16


def test_media_edges(spark, edges, nothing):
    found = media.features(media.stored(edges, f"{common.workspace(spark)}/m")).collect()
    assert len(found) == 9 and len({(r.media_sha256, bytes(r.cosine_hash)) for r in found if r.id in (1, 5)}) == 1
    assert media.features(media.stored(nothing, f"{common.workspace(spark)}/m")).count() == 0


def slow_repeats(words):
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({p for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)})


def test_quality_rules_against_brute_force(spark, sf_dir, texts):
    for r in quality_rules.op10_quality_rules(spark, sf_dir).collect():
        words = re.findall("[^\x20\x09-\x0d]+", texts[r.doc_id])
        lines = [x for x in texts[r.doc_id].split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", texts[r.doc_id])), len(lines) - len(set(lines)), slow_repeats(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_rules_agree_with_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = c.sql(quality_rules.SQL["op10_quality_rules"]).df()
    got = quality_rules.op10_quality_rules(spark, sf_dir).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").reset_index(drop=True).astype(str).equals(want.sort_values("doc_id").reset_index(drop=True).astype(str))


def test_quality_rules_edges(edges, nothing):
    rows = quality_rules.score(edges).collect()
    assert len(rows) == 9 and all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.row.doc_id in (2, 3, 4))
    assert [r.n_repeat_words for r in rows if r.row.doc_id == 6] == [30_000] and quality_rules.score(nothing).count() == 0


def test_classifier_tells_held_out_junk(spark):
    """Trained on the labels of three of four documents, tested on the rest."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    found = kneser_ney.classify(docs, labels.where("doc_id % 4 <> 0"), common.workspace(spark)).select("row.doc_id", "kept")
    kept = {r.doc_id: r.kept for r in found.collect()}
    held = labels.where("doc_id % 4 = 0").collect()
    good, junk = [kept[r.doc_id] for r in held if r.quality == 1], [kept[r.doc_id] for r in held if r.quality == 0]
    assert sum(good) / len(good) >= 0.95 and sum(junk) / len(junk) <= 0.35


def test_classifier_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, None), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = kneser_ney.classify(edges, labels, common.workspace(spark))
    assert out.count() == 9 and all(r.kept and r.perplexity is None for r in out.collect() if r.row.doc_id in (2, 3, 4))
    assert kneser_ney.classify(nothing, labels, common.workspace(spark)).count() == 0
    assert kneser_ney.classify(edges, labels.where("false"), common.workspace(spark)).where("kept").count() == 9


def test_sentence_pieces_against_the_library(spark, sf_dir, texts):
    enc = sentence_pieces.Encoder(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    rows = sentence_pieces.op2_sentence_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(enc.library.encode(texts[r.doc_id]), dtype="<i4").tobytes())


def test_sentence_pieces_edges(edges, nothing):
    """Null and empty texts have no ids; a very long text and one long word come back; extra columns are not looked at."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentence_pieces.decode(sentence_pieces.encode(edges.withColumn("ids", F.lit("x")).withColumn("a.b", F.lit(1)), path), path).collect()
    assert len(rows) == 9 and all(r.decoded == r.text for r in rows)
    assert sorted(len(r.ids) for r in rows if r.id in (2, 3)) == [0, 0] and len({bytes(r.ids) for r in rows if r.id in (1, 5)}) == 1
    assert sentence_pieces.decode(sentence_pieces.encode(nothing, path), path).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)  # noqa: N815
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.workspace(Session)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t▁日", max_size=30))
def test_units(text):
    enc = sentence_pieces.encoder(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    assert enc.encode(text).tolist() == enc.library.encode(text)


def test_lattice_against_brute_force(spark):
    table = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -5.0, "aba": -8.5, "abab": -9.5, "c": -2.0, "bc": -4.5}

    def best(word):
        ends = {0: 0.0}
        for k in range(1, len(word) + 1):
            ways = [ends[j] + table.get(word[j:k], sentence_pieces.UNKNOWN if k - j == 1 else -math.inf) for j in range(k)]
            ends[k] = max(ways)
        return ends[len(word)]

    words = ["abab", "ababc", "bacab", "x", "axb", "a", "é😀ab"]
    rows = sentence_pieces.lattice(spark.createDataFrame([(w,) for w in [*words, "a", None, ""]], "word string"), spark.createDataFrame(list(table.items()), "piece string, score double")).collect()
    assert {r.word for r in rows} == set(words)
    for r in rows:
        assert "".join(r.pieces) == r.word and math.isclose(r.score, best(r.word)) and math.isclose(sum(table.get(p, sentence_pieces.UNKNOWN) for p in r.pieces), r.score)


def test_merges_against_the_library(spark, texts):
    """The lattice folded by merges gives the library's pieces for every distinct word of the smallest table."""
    enc = sentence_pieces.Encoder(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    lib = enc.library
    table = [(lib.id_to_piece(i), lib.get_score(i)) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
    pieces = spark.createDataFrame(table, "piece string, score double")
    signs = {p for p, _ in table}
    words = sorted({sentence_pieces.SPACE + w for t in texts.values() for w in re.findall("[^\x20\x09-\x0d]+", t) if set(w) <= signs})[::7] + ["▁aaaa", "▁"]
    found = {r.word: r.pieces for r in sentence_pieces.merged(spark.createDataFrame([(w,) for w in [*words, None, "", words[0]]], "word string"), pieces).collect()}
    assert found == {w: lib.encode(w[1:], out_type=str) if len(w) > 1 else ["▁"] for w in words}


def test_compaction(spark, edges, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "TARGET", 1 << 20)
    store = compaction.Store(spark, f"{tmp_path}/s")
    assert store.version() == 0 and store.manifest().count() == 0
    for k in range(5):
        assert store.append(edges if k else nothing) == k + 1
        assert store.read().count() == 9 * k and set(store.read().columns) == {*edges.columns, "shard"}
    before = sorted(map(str, store.read().drop("shard").collect()))
    small = store.manifest().count()
    assert store.compact() == 6 and store.compact() == 6
    assert store.manifest().count() < small and sorted(map(str, store.read().drop("shard").collect())) == before
    assert store.read(3).count() == 18 and store.manifest().agg({"rows": "sum"}).head()[0] == 36


def test_racing_writers_lose_nothing(spark, edges, tmp_path):
    """Eight writers at once, each with its own rows: every commit is there, in a version of its own."""
    stores = [compaction.Store(spark, f"{tmp_path}/s") for _ in range(8)]
    frames = [edges.withColumn("writer", F.lit(k)) for k in range(8)]
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda x: x[0].append(x[1]), zip(stores, frames, strict=True)))
    assert sorted(versions) == list(range(1, 9))
    assert {r.writer: r["count"] for r in stores[0].read().groupBy("writer").count().collect()} == {k: 9 for k in range(8)}


def test_a_taken_version_is_refused_and_a_merge_of_merged_shards_given_up(spark, edges, tmp_path):
    store = compaction.Store(spark, f"{tmp_path}/s")
    for _ in range(4):
        store.append(edges)
    assert not store._claim(4, "m-other", StructType()) and store.version() == 4
    other, taken = compaction.Store(spark, f"{tmp_path}/s"), []
    plain = store._commit
    store._commit = lambda change: (taken.append(other.compact()), plain(change))[1]  # another merge comes first
    assert store.compact() == 5 and taken == [5] and store.read().count() == 36


def test_manifest_against_brute_force(spark, tmp_path, monkeypatch):
    """Tiers, sizes and rows of the manifest are those of the files; merged files are about the target's size."""
    monkeypatch.setattr(compaction, "TARGET", 256 << 10)
    monkeypatch.setattr(compaction, "SMALLEST", 4 << 10)
    store = compaction.Store(spark, f"{tmp_path}/s")
    rows = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for k in range(12):
        store.append(rows.where(F.col("id") % 12 == k).coalesce(1 + k % 3))
    while (v := store.version()) != store.compact():
        pass
    found = store.manifest().collect()
    for r in found:
        file = r.path.removeprefix("file:").removeprefix("//")
        assert r.bytes == os.path.getsize(file) and r.rows == pq.read_metadata(file).num_rows
        assert r.tier == max(0, math.floor(math.log(max(r.bytes, 4 << 10) / (4 << 10), 4) + 1e-9))
    tiers = Counter(r.tier for r in found if r.bytes < 256 << 10)
    assert all(n < compaction.FANOUT or math.ceil(sum(r.bytes for r in found if r.tier == t and r.bytes < 256 << 10) / (256 << 10)) >= n for t, n in tiers.items())
    assert max(r.bytes for r in found) < 2 * (256 << 10) and v == store.version()
    assert sorted(r.id for r in store.read().select("id").collect()) == list(range(60_000))


def test_sharding_keeps_every_row(spark, sf_dir, texts):
    rows = compaction.op8_sharding(spark, sf_dir).collect()
    assert {r.doc_id: r.n_bytes for r in rows} == {k: len(t.encode()) for k, t in texts.items()} and len(rows) == len(texts)


def test_sharding_of_an_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert compaction.op8_sharding(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    path, columns, ids = common.workspace(spark), docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, sf_dir), f"{path}/{k}")
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert now and (ids is None or now <= ids), name
        ids = now
        if name != "packing":
            assert docs.columns == columns, name
        if name in ("lines", "near-duplicates", "personal-data"):
            assert docs.count() == len(now)
    assert set(docs.columns) >= {"doc_id", "sequence_id", "offset"}


def test_pipeline_stages_take_edges(spark, edges, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edges, sf_dir)
        assert out.columns == edges.columns and out.count() > 0, name


def test_compaction_keeps_columns_that_come_and_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "SMALLEST", 1 << 20)
    store = compaction.Store(spark, f"{tmp_path}/s")
    arrivals = [([(1,)], "id long"), ([(2, "x")], "id long, extra string"), ([("y", 3)], "EXTRA string, id long"), ([(4, 0.5)], "id long, score double")]
    for rows, schema in arrivals:
        store.append(spark.createDataFrame(rows, schema).coalesce(1))
    want = [(1, None, None), (2, "x", None), (3, "y", None), (4, None, 0.5)]
    rows = lambda v=None: sorted(tuple(r)[:3] for r in store.read(v).collect())
    before = store.version()
    assert store.read().columns == ["id", "extra", "score", "shard"] and rows() == want
    assert store.compact() == before + 1 and rows() == want and rows(before) == want and store.manifest().count() == 1
    with pytest.raises(ValueError, match="extra is int"):
        store.append(spark.createDataFrame([(5, 5)], "id long, extra int"))
    assert store.version() == before + 1 and store.read(1).columns == ["id", "shard"]


class _OtherFileSystem:
    """The local file system as one that is none: pointers are created exclusively, not linked."""

    def __init__(self, fs):
        self._fs = fs

    def __getattr__(self, name):
        return getattr(self._fs, name)

    def getScheme(self):
        return "hdfs"


def test_racing_writers_elsewhere(spark, tmp_path):
    stores = [compaction.Store(spark, f"{tmp_path}/s") for _ in range(4)]
    for s in stores:
        s._fs = _OtherFileSystem(s._fs)
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: stores[k].append(spark.range(k, k + 1).coalesce(1)), range(4)))
    assert sorted(versions) == [1, 2, 3, 4] and sorted(r.id for r in stores[0].read().collect()) == [0, 1, 2, 3]


def test_a_pointer_that_is_never_finished(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "WAITS", 2)
    store = compaction.Store(spark, f"{tmp_path}/s")
    store.append(spark.range(3).coalesce(1))
    open(f"{tmp_path}/s/manifest/v2", "w").close()
    with pytest.raises(OSError, match="not finished"):
        store.read()
    assert store.read(1).count() == 3
