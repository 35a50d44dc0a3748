"""The pipeline's near-duplicates stage against brute-force Jaccard of five-word shingles."""

import random
from itertools import combinations

import pytest
from test_pairs import roots

from inkmill.llm import common, near_copies, simhash


def _set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def _want(texts):
    sets = {k: _set(t) for k, t in texts.items()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    root = roots(texts, [(a, b) for a, b in combinations(sorted(texts), 2) if alike(sets[a], sets[b])])
    return {k for k, v in root.items() if k == v}


@pytest.fixture(scope="module")
def edited():
    """Copies with one to nine words changed, chains of them, a passage in many texts, and short ones."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(3000)}"
    passage, texts = [word() for _ in range(40)], {}
    for group in range(12):
        base = [word() for _ in range(r.choice((6, 60, 150, 400)))]
        for copy in range(12):
            words = base.copy()
            for _ in range(copy % 10):
                words[r.randrange(len(words))] = word()
            if copy == 11:
                base = words
            texts[len(texts)] = " ".join(words)
    for _ in range(40):
        texts[len(texts)] = " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])
    return texts | {1000: "One two", 1001: "one TWO", 1002: "two one", 1003: "", 1004: " "}


@pytest.mark.parametrize("pairs", [near_copies.BROADCAST_PAIRS, 0])
def test_edited_copies(spark, tmp_path, edited, monkeypatch, pairs):
    monkeypatch.setattr(near_copies, "BROADCAST_PAIRS", pairs)
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    spark.createDataFrame(list(edited.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    want = _want(edited)
    assert len(want) < len(edited)
    assert {r.doc_id for r in simhash.keep_one(spark.read.parquet(f"{tmp_path}/d")).collect()} == want


def test_smallest_table(spark, sf_dir, texts):
    assert {r.doc_id for r in simhash.keep_one(common.table(spark, sf_dir, "documents")).collect()} == _want(texts)


def test_fingerprints_meet_by_covering_lsh_first(spark, tmp_path, edited, monkeypatch):
    """Candidates come from SimHash's tables; what they link is right, and the hubs get what is left."""
    spark.createDataFrame(list(edited.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    asked, verified = [], near_copies._verified

    def seen(pairs, rows, path):
        out = verified(pairs, rows, path)
        asked.append((path.rsplit("/", 1)[1], pairs.count(), out.collect()))
        return out

    monkeypatch.setattr(near_copies, "_verified", seen)
    kept = {r.doc_id for r in simhash.keep_one(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert kept == _want(edited) and [name for name, *_ in asked] == ["fingerprint", "hub", "rest"]
    first, sets = asked[0], list(edited.values())
    assert first[1] >= len(first[2]) > 5
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    places = {r.k: r.t for r in common.numbered(spark.read.parquet(f"{tmp_path}/d"), {"t": common.text_of("text")}).collect()}
    assert all(alike(_set(places[r.x]), _set(places[r.y])) for r in first[2]) and set(places.values()) == set(sets)
