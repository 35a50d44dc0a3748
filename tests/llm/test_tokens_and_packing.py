import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkmill.llm import common, packing, token_store
from inkmill.llm.encoding import encoder, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids + [end], dtype="<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbZ 'stréÉ́̌JσΣς日½0.9,!?<|>\t\n\r\x0b\x1c  "), max_size=40))
def test_ids_are_the_librarys(text):
    enc = encoder(vocabulary(PATH))
    assert np.frombuffer(enc.encode(text), dtype=enc.width).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "don't WE'LL x'y", "J̌", "ΟΔΟΣ", ""])
def test_ids_of_odd_texts(text):
    enc = encoder(vocabulary(PATH))
    assert np.frombuffer(enc.encode(text), dtype=enc.width).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_store_against_the_library(spark, sf_dir, texts):
    got = {r.doc_id: r for r in token_store.op1_token_store(spark, sf_dir).collect()}
    start = 0
    for k in sorted(texts):
        ids = ids_of(texts[k], 1)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_store_reads_single_documents(spark, edges):
    path = f"{common.workspace(spark)}/t"
    token_store.write(edges, path, PATH, 1)
    assert token_store.document(spark, path, 3) == [[1]] and len(token_store.document(spark, path, 1)) == 2 and token_store.document(spark, path, 99) == []
    rows = token_store.read(spark, path).collect()
    assert len(rows) == 9 and sorted(r.n_tokens for r in rows if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    placed = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False))


def test_store_of_nothing(spark, nothing):
    path = f"{common.workspace(spark)}/t"
    token_store.write(nothing, path, PATH, 1)
    assert token_store.read(spark, path).count() == 0


def test_shard_rejects_another_dictionary():
    writer = token_store.ShardWriter(np.dtype("<u2"), b"")
    writer.add(None, np.array([1, 2], dtype="<u2").tobytes())
    data = writer.close()["data"]
    assert token_store.ShardReader(data, b"").ids(0).tolist() == [1, 2]
    with pytest.raises(ValueError, match="dictionary"):
        token_store.ShardReader(data, b"other")


def check_pieces(rows, ids, length):
    """Every id in one piece, checksums, no gap in a sequence; returns the fills."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, v in ids.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(v) and r.ids_crc32 == zlib.crc32(v[at : at + r.length].tobytes())
            at += r.length
        assert at == len(v)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return [sum(r.length for r in rs) for rs in by_sequence.values()]


def test_packing_against_the_library(spark, sf_dir, texts):
    fills = check_pieces(packing.op4_packing(spark, sf_dir).collect(), {k: ids_of(t, 2) for k, t in texts.items()}, 4096)
    assert sum(f < 4096 for f in fills) <= 1


@pytest.mark.parametrize("length", [7, 64])
def test_packing_of_short_sequences(spark, sf_dir, texts, length):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fills = check_pieces(packing.pack(docs, PATH, 2, length=length).collect(), {k: ids_of(t, 2) for k, t in texts.items()}, length)
    assert sum(f < length for f in fills) <= 1


def test_packing_edges(spark, edges, nothing):
    rows = packing.pack(edges, PATH, 2).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(t or "", 2)) for t in [r.text for r in edges.collect()])
    assert packing.pack(nothing, PATH, 2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 40), max_size=12))
def test_plan_uses_no_more_than_there_is(histogram):
    plan = packing.Plan(histogram, 16)
    assert all(n <= histogram[k] for k, n in plan.used.items())
    filled = defaultdict(list)
    for k, n in histogram.items():
        sequence, offset = plan.places(np.full(n, k), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            if s >= 0:
                filled[s].append((o, k))
    assert sorted(filled) == list(range(plan.sequences))
    for parts in filled.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at == 16


def test_least_squares_is_not_negative():
    histogram = {4: 10, 12: 7, 8: 9, 2: 3}
    combos = packing.combinations(histogram, 16)
    assert all(sum(c) == 16 for c in combos) and (packing.least_squares(combos, histogram) >= 0).all()
