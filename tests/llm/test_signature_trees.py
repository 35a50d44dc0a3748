import random
import re
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.llm import signature_trees

from test_pairs import roots

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def linked(a, b):
    return a and b and 100 * len(a & b) >= 90 * len(a | b)


def slow_similar(rows):
    """(id, set size, component) for rows (id, text) with ids that do not repeat."""
    sets = {i: slow_set(t) for i, t in rows}
    found = roots(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if linked(sets[a], sets[b])])
    return sorted((i, len(s), found[i]) for i, s in sets.items())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbé \t\n", max_size=40), st.text(alphabet="aAbé \t\n", max_size=40))
def test_sets(x, y):
    a, b = signature_trees.shingles(x), signature_trees.shingles(y)
    assert len(a) == len(slow_set(x)) and len(set(a.tolist()) & set(b.tolist())) == len(slow_set(x) & slow_set(y))


@pytest.fixture(scope="module")
def groups(spark, tmp_path_factory):
    """Chains and stars of near copies, of all lengths, with a passage that all share."""
    rng, rows, passage = random.Random(3), [], [f"p{k}" for k in range(12)]
    for g in range(12):
        size = rng.choice([1, 2, 3, 12, 40, 120, 300])
        text = [f"g{g}w{k}" for k in range(size)] + (passage if g % 2 else [])
        for _ in range(14):
            rows.append(" ".join(text))
            text = text.copy() if g % 3 else text[:size]
            for _ in range(rng.choice([1, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    rows += [" ".join(passage), " ".join(passage[:2]), "", "  \n", None, "one", "ONE"]
    rows = list(enumerate(rows))
    path = str(tmp_path_factory.mktemp("groups") / "t.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return rows, spark.read.parquet(path)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_against_brute_force(groups):
    rows, docs = groups
    want = slow_similar(rows)
    assert len({c for _, _, c in want}) < len(want) - 20 and got(signature_trees.similar(docs)) == want


def test_trees_alone_find_every_link(spark, groups, tmp_path):
    """All sets enter trees, whether a hub has linked them or not: no linked pair goes in the traversal."""
    from pyspark.sql import functions as F

    rows, docs = groups
    marked = signature_trees._marked(docs.where("text IS NOT NULL").selectExpr("doc_id AS i", "xxhash64(text) AS th", "text AS t"))
    entries = marked.where("n > 0").select(F.col("i").alias("k"), F.posexplode("prefix").alias("at", "w"), "n", "beyond", "least_hash", "bitmap").selectExpr(
        "w", "int(floor(ln(n) / ln(10 / 9.0D))) AS s", "least_hash AS p", "k", "n AS low", "n AS high", "n - at AS rest", "beyond", "k AS first", "k AS last", *[f"bitmap[{j}] AS b{j}" for j in range(8)]
    )
    found = {(min(r), max(r)) for r in map(tuple, signature_trees.traverse(entries, str(tmp_path / "tree")).collect())}
    sets = [(i, slow_set(t)) for i, t in rows]
    want = {(i, j) for (i, a), (j, b) in combinations(sets, 2) if linked(a, b)}
    assert want and want <= found


def test_texts_beyond_the_broadcast(groups, monkeypatch):
    rows, docs = groups
    monkeypatch.setattr(signature_trees, "BROADCAST_SETS", 0)
    assert got(signature_trees.similar(docs)) == slow_similar(rows)


def test_query_against_brute_force(spark, sf_dir, texts):
    assert got(signature_trees.op11_signature_trees(spark, sf_dir)) == slow_similar(list(texts.items()))


def test_edges(edges, nothing):
    rows = signature_trees.similar(edges).collect()
    assert len(rows) == 9 and {r.id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7, None: None}
    assert {r.id: r.n_shingles for r in rows} == {i: len(slow_set(t)) for i, t, *_ in edges.collect()}
    assert signature_trees.similar(nothing).count() == 0
