"""Pages that refer to each other, against all pairs."""

import random

from inkmill.operators import references


def test_mutual_references_against_all_pairs(spark):
    rng = random.Random(3)
    anchors = {p: {rng.choice("abcdef") for _ in range(rng.randrange(3))} for p in range(40)}
    edges = {p: {rng.choice("abcdefgh") for _ in range(rng.randrange(4))} for p in range(40)}
    rows = lambda d: [(p, x) for p, xs in d.items() for x in xs]
    got = references.mutual(spark.createDataFrame(rows(edges) * 2, "source long, target string"), spark.createDataFrame(rows(anchors) * 2, "page_id long, anchor string"))
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if edges[a] & anchors[b] and edges[b] & anchors[a]}
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_one_way_references_make_no_pairs(spark):
    # 20,000 pages refer to one word that 20,000 others have for a title: 400 million pairs one way.
    pages = spark.range(40_000)
    edges = pages.where("id < 20000").selectExpr("id AS source", "'/b' AS target")
    anchors = pages.selectExpr("id AS page_id", "CASE WHEN id < 20000 THEN '/a' ELSE '/b' END AS anchor")
    assert references.mutual(edges, anchors).count() == 0
