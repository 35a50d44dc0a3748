"""Batches, quotes with edits and replies against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from inkmill.operators import anchors, replies


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_anchor(quote, text, share):
    k, m, best = int(share * len(quote)), len(quote), None
    if m < 8:
        return None
    for s in range(len(text)):
        for n in range(max(1, m - 2), m + 3):
            if s + n <= len(text) and (e := distance(quote, text[s : s + n])) <= k and (best is None or (e, s, abs(n - m), n) < best):
                best = (e, s, abs(n - m), n)
    return best and (best[1], best[1] + best[3], best[0])


@pytest.mark.parametrize("share", [0.0, 0.15, 0.3])
def test_quotes_against_every_window(spark, share):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abc d", k=rng.choice([10, 60, 110]))) for _ in range(8)] + ["", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", None]
    quotes = []
    for d, t in enumerate(texts):
        for _ in range(4):
            at = rng.randrange(max(1, len(t or "") - 12))
            q = list((t or "nothing to find")[at : at + rng.choice([6, 9, 20])])
            for _ in range(rng.randrange(4)):
                if q:
                    q[rng.randrange(len(q))] = rng.choice(["", "x", "ab"])
            quotes.append((len(quotes), d, "".join(q)))
    quotes.append((len(quotes), 0, None))
    got = anchors.anchor(spark.createDataFrame(quotes, "quote_id long, doc_id long, quote string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), share)
    want = {i: slow_anchor(q or "", texts[d] or "", share) for i, d, q in quotes}
    assert {r.quote_id: (r.start, r.end, r.edits) for r in got.collect()} == {i: w for i, w in want.items() if w} and (share == 0.0 or any(w and w[2] for w in want.values()))


def test_quotes_of_documents_are_found(spark, sf_dir):
    from inkmill.plans import anchoring

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = anchoring.fuzzy_anchors(spark, sf_dir).collect()
    assert len(rows) == sum(len(t or "") >= 100 for t in docs.values()) and all(r.edits <= 2 for r in rows)
    assert sum(r.start == len(docs[r.doc_id]) // 3 for r in rows) > 0.9 * len(rows)  # elsewhere: copies within the text


def test_batches_and_offsets(spark):
    blocks = [(1, 0, "One \U0001f600 two."), (1, 1, "  "), (1, 2, "Three four."), (1, 3, None), (1, 4, "x" * 30), (1, 5, "Five."), (2, 0, "Alone")]
    placed = anchors.batches(spark.createDataFrame(blocks, "doc_id long, block_idx int, content string"), 30)
    assert sorted((r.doc_id, r.block_idx, r.batch, r.start16, r.end16) for r in placed.collect()) == [(1, 0, 0, 0, 11), (1, 2, 0, 13, 24), (1, 4, 1, 0, 30), (1, 5, 2, 0, 5), (2, 0, 0, 0, 5)]
    matches = [(1, 0, 4, 2), (1, 0, 7, 3), (1, 0, 13, 5), (1, 0, 8, 8), (1, 0, 24, 1), (1, 2, 0, 5), (2, 0, 0, 6), (9, 0, 0, 1)]
    got = anchors.resolve(spark.createDataFrame(matches, "doc_id long, batch int, offset long, length long"), placed)
    assert sorted((r.doc_id, r.block_idx, r.start, r.flagged) for r in got.collect()) == [(1, 0, 4, "\U0001f600"), (1, 0, 6, "two"), (1, 2, 0, "Three"), (1, 5, 0, "Five.")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('[{"a": 1}, {"a": 2}]', [1, 2]),
        ('```json\n[{"a": 1,}, {"a": 2},]\n```', [1, 2]),
        ('[{"a": 1}, {"a": 2}, {"a":', [1, 2]),
        ('{"reasoning": "an { object", "issues": [{"a": 1}, {"a": 2}, {"', [1, 2]),
        ('{"reasoning": "x", "issues": [{"a": 1}]}', [1]),
        ('{"a": 5}', [5]),
        ('[{"a": 1}, {"t": "}, {\\" ,]", "a": 2}, {"a": 3', [1, 2]),
        ('[{"a": {"b": {}}}, 7, "x", null, {"a": 4}]', [-1, 4]),
        ('[{"a": "many"}]', [-1]),
        ("I can not say.", []),
        ("", []),
        (None, []),
    ],
)
def test_replies(spark, raw, want):
    found = replies.objects(spark.createDataFrame([(1, raw)], "id int, raw string"))
    assert [r.a for r in found.select("pos", replies.field(F.col("item"), "a", "int", -1).alias("a")).orderBy("pos").collect()] == want


def test_commas_in_strings_stay(spark):
    raw = '[{"t": "a, ]", "u": "b,}",}]'
    item = replies.objects(spark.createDataFrame([(raw,)], "raw string")).select(F.to_json("item").alias("j")).head().j
    assert json.loads(item) == {"t": "a, ]", "u": "b,}"}
