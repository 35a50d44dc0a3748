import re
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.llm import line_dedup, simhash
from inkmill.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n\x1c .", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_masks_cover_every_pair_of_bits():
    masks = simhash.masks()
    assert len(masks) == 7 and all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a, b in combinations(range(64), 2))


def test_simhash_against_brute_force(spark, sf_dir, texts):
    prints = {k: slow_fingerprint(t) for k, t in texts.items()}
    want = roots(texts, [(a, b) for a, b in combinations(sorted(texts), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {r.doc_id: r for r in simhash.op5_simhash(spark, sf_dir).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(int(got[k].fingerprint, 16) == v and len(got[k].fingerprint) == 16 for k, v in prints.items())


def test_links_keep_every_near_pair(spark):
    base = [0, 0x123456789ABCDEF0, 0xFFFFFFFFFFFFFFFF, 0x8000000000000001]
    prints = sorted({b ^ (1 << i) ^ (1 << j) for b in base for i in (0, 5, 31, 63) for j in (0, 17, 62)} | set(base))
    want = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(nodes).collect()]
    got = roots(prints, edges)
    assert len(set(got.values())) == len(set(want.values())) and all((got[a] == got[b]) == (want[a] == want[b]) for a, b in combinations(prints, 2))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 130))


def test_simhash_edges(spark, edges, nothing):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.id in (2, 3, 4)} == {2} and {r.component_id for r in rows if r.id in (1, 5)} == {1}
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 6), (False, 7), (True, 0)]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def slow_lines(rows):
    """(id, line number) of the removed lines, by comparing each line with all before it."""
    lines = [(i, n, frozenset(WORD.findall(x))) for i, t in rows for n, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    return [(i, n) for k, (i, n, s) in enumerate(lines) if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for _, _, o in lines[:k])], lines


@pytest.fixture(scope="module")
def similar(spark, tmp_path_factory):
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):  # variants of a long and of a short line, repeated lines, common words
        long = words[:30].copy()
        long[k % 30] = f"x{k}"
        long[(7 * k) % 30] = f"y{k % 5}"
        short = words[30:40].copy()
        short[k % 10] = f"z{k % 3}"
        rows.append((k, "\n".join([" ".join(long), " ".join(short), "the of and", f"the of and to w{k % 4}", "", " ".join(words[k : k + 9]), "tab\tand\rreturn " + words[k]])))
    path = str(tmp_path_factory.mktemp("similar") / "t.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return rows, spark.read.parquet(path)


def test_lines_against_brute_force(similar):
    rows, docs = similar
    removed, _ = slow_lines(rows)
    assert removed and sorted((r.i, n) for r in line_dedup.decide(docs).collect() for n in r.removed) == sorted(removed)


def test_lines_beyond_the_broadcast(similar, monkeypatch):
    rows, docs = similar
    monkeypatch.setattr(line_dedup, "BROADCAST_PAIRS", 0)
    assert sorted((r.i, n) for r in line_dedup.decide(docs).collect() for n in r.removed) == sorted(slow_lines(rows)[0])


def test_line_edges(edges, nothing):
    out = line_dedup.dedupe(edges)
    assert out.columns == edges.columns
    rows = out.collect()
    assert len(rows) == 9 and sorted((r.text is None, r.text or "") for r in rows if r.doc_id in (2, 3, 4)) == [(False, ""), (False, " \n\t\r\n "), (True, "")]
    assert sorted(len(r.text) for r in rows if r.doc_id in (1, 5))[:2] == [0, 0] and [r.row for r in rows if r.doc_id == 6] == ["long"]
    assert line_dedup.dedupe(nothing).count() == 0 and line_dedup.decide(nothing).count() == 0
