"""Tier merge, nested blocks and the module graph against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from inkmill.operators import forest, modules, tiers

ISSUE = "doc_id long, ord int, source string, category string, flagged string, start long, end long, confidence double"


def issue(ord, flagged="test text", source="granular", category="style", span=(0, 0), confidence=1.0, doc=1):
    return (doc, ord, source, category, flagged, *span, confidence)


def norm(t):
    return " ".join((t or "").lower().split())


def within(a, b):
    a, b = sorted((a.split(), b.split()), key=len)
    return any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))


def lap(x, y):
    """Overlap as a share of the shorter of two known spans."""
    (a, b), (c, d) = x[5:7], y[5:7]
    known = (a or b) and (c or d)
    return (min(b, d) - max(a, c)) / max(1, min(b - a, d - c)) if known else 0


def slow_dedup(issues):
    kept = []
    for y in sorted(issues, key=lambda i: (i[0], i[1])):
        t = norm(y[4])
        rival = lambda x: x[0] == y[0] and norm(x[4]) and (norm(x[4]) == t or (x[2] == y[2] and within(norm(x[4]), t)) or lap(x, y) > 0.8)  # noqa: B023, E731
        if not t or not any(map(rival, kept)):
            kept.append(y)
    return kept


def slow_merge(rules, checker, model, confidence=0.7):
    kept = list(rules)
    for y in [*sorted(checker, key=lambda i: i[1]), *[m for m in slow_dedup(model) if m[7] >= confidence]]:
        group = lambda c: {"style": "language", "grammar": "language", "word-usage": "language"}.get(c, c)
        if not any(x[0] == y[0] and group(x[3]) == group(y[3]) and (lap(x, y) > 0.5 or (norm(y[4]) and norm(x[4]) == norm(y[4]))) for x in kept):
            kept.append(y)
    return kept


def table(spark, rows):
    return spark.createDataFrame(rows, ISSUE)


def ids(df):
    return sorted((r.doc_id, r.ord) for r in df.select("doc_id", "ord").collect())


@pytest.mark.parametrize(
    ("issues", "kept"),
    [
        ([issue(1, "utilize"), issue(2, "Utilize ")], [1]),
        ([issue(1, "utilize"), issue(2, "utilize", "global")], [1]),  # one text counts across sources
        ([issue(1, "be used"), issue(2, "the program is ready to be used")], [1]),
        ([issue(1, "the program is ready to be used"), issue(2, "be used")], [1]),
        ([issue(1, "be used"), issue(2, "is ready to be used", "global")], [1, 2]),  # contained words within a source alone
        ([issue(1, "use"), issue(2, "be used")], [1, 2]),  # whole words
        ([issue(1, "a", span=(100, 120)), issue(2, "b", span=(104, 124))], [1, 2]),  # four fifths exactly
        ([issue(1, "a", span=(100, 120)), issue(2, "b", span=(103, 123))], [1]),
        ([issue(1, "a", span=(0, 0)), issue(2, "b", span=(0, 0))], [1, 2]),  # unknown spans
        ([issue(1, ""), issue(2, None), issue(3, " ")], [1, 2, 3]),  # nothing said, nothing repeated
        ([issue(1, "a b"), issue(2, "b c a b", span=(10, 20)), issue(3, "c", span=(10, 20))], [1, 3]),  # who has gone beats nobody
        ([issue(1, "x", doc=1), issue(1, "x", doc=2)], [1, 1]),
    ],
)
def test_model_issues(spark, issues, kept):
    assert sorted(o for _, o in ids(tiers.dedup_model(table(spark, issues)))) == kept
    assert sorted(i[1] for i in slow_dedup(issues)) == kept


def test_tiers_told_plainly(spark):
    rules = [issue(1, "tool", "rules", "style", (10, 14)), issue(2, "tool", "rules", "style", (10, 14))]
    checker = [issue(1, "tools", "checker", "grammar", (10, 15)), issue(2, "tools", "checker", "punctuation", (10, 15)), issue(3, "far", "checker", "grammar", (50, 53))]
    model = [issue(1, "far", "global", "style", (0, 0)), issue(2, "unsure", confidence=0.6), issue(3, "sure", confidence=0.7)]
    got = tiers.merge_tiers(*(table(spark, t) for t in (rules, checker, model)))
    assert sorted((r.tier, r.ord) for r in got.collect()) == [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]
    none = table(spark, [])
    assert tiers.merge_tiers(none, none, none).count() == 0


def test_tiers_against_a_fold(spark):
    rng = random.Random(2)
    words = "a b c d e".split()

    def some(source, n):
        rows = []
        for k in range(n):
            s = rng.randrange(0, 700)
            span = rng.choice([(0, 0), (s, s + rng.randrange(1, 12)), (s, s + 300)])
            rows.append(issue(k, rng.choice(["", " ".join(rng.choices(words, k=rng.randrange(1, 5)))]), rng.choice(source), rng.choice(["style", "grammar", "punctuation"]), span, rng.choice([0.6, 0.9]), rng.randrange(4)))
        return rows

    rules, checker, model = some(["rules"], 20), some(["checker"], 60), some(["granular", "global"], 120)
    dedup = tiers.dedup_model(table(spark, model))
    assert ids(dedup) == sorted(i[:2] for i in slow_dedup(model))
    want = slow_merge(rules, checker, model)
    got = tiers.merge_tiers(*(table(spark, t) for t in (rules, checker, model)))
    name = lambda i: (i[0], i[2] in ("granular", "global"), i[2] == "checker", i[1])
    assert sorted(name(tuple(r)) for r in got.select("doc_id", "ord", "source").collect()) == sorted(name(i) for i in want)


def slow_forest(parents):
    kids = {}
    for v in sorted(parents):
        kids.setdefault(parents[v] if parents[v] in parents else None, []).append(v)
    out, clock = {}, [0, 0]

    def visit(v, number, depth):
        clock[0], clock[1] = clock[0] + 1, clock[1] + 1
        lft, place = clock[0], clock[1]
        size = 1 + sum(visit(c, f"{number}.{k}", depth + 1) for k, c in enumerate(kids.get(v, []), 1))
        clock[0] += 1
        out[v] = (depth, number, size, lft, clock[0], place)
        return size

    for k, v in enumerate(kids.get(None, []), 1):
        visit(v, str(k), 0)
    return out


def test_nested_sets_of_any_shape(spark):
    rng = random.Random(4)
    shapes = [{k: (k - 1 if k else None) for k in range(70)}, {k: (rng.randrange(k) if k and rng.random() < 0.9 else None) for k in range(60)}, {3: None, 1: 3, 2: 3, 0: 1, 9: 77}]
    rows = [(d, v, p) for d, shape in enumerate(shapes) for v, p in shape.items()]
    got = forest.numbered(spark.createDataFrame(rows, "doc_id long, block_idx int, parent_idx int")).collect()
    for d, shape in enumerate(shapes):
        assert {r.block_idx: (r.depth, r.number, r.size, r.lft, r.rgt, r.place) for r in got if r.doc_id == d} == slow_forest(shape)
    assert forest.numbered(spark.createDataFrame([], "doc_id long, block_idx int, parent_idx int")).count() == 0


def test_a_cycle_of_parents_raises(spark):
    with pytest.raises(ValueError, match="cycle"):
        forest.numbered(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "doc_id long, block_idx int, parent_idx int"))


def test_parents_by_level_and_counters(spark):
    kinds = [("heading", 1), ("paragraph", 0), ("heading", 2), ("heading", 4), ("paragraph", 0), ("heading", 3), ("heading", 2), ("heading", 1), ("heading", 2)]
    rows = [(1, k, t, level) for k, (t, level) in enumerate(kinds)] + [(2, 0, "paragraph", 0), (2, 1, "heading", 3)]
    blocks = forest.parents_by_level(spark.createDataFrame(rows, "doc_id long, block_idx int, block_type string, level int"))
    assert [r.parent_idx for r in blocks.where("doc_id = 1").orderBy("block_idx").collect()] == [None, 0, 0, 2, 3, 2, 0, None, 7]
    heads = forest.numbered(blocks.where("block_type = 'heading'"))
    assert [r.number for r in heads.where("doc_id = 1").orderBy("block_idx").collect()] == ["1", "1.1", "1.1.1", "1.1.2", "1.2", "2", "2.1"]


def slow_components(edges):
    out = {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
        out.setdefault(t, set())

    def reach(v):
        seen, todo = set(), [v]
        while todo:
            for w in out[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        return seen

    reached = {v: reach(v) for v in out}
    comp = {v: min([v, *(w for w in reached[v] if v in reached[w])]) for v in out}

    def layer(c):
        before = {comp[s] for s, t in edges if comp[t] == c and comp[s] != c}
        return 1 + max(map(layer, before)) if before else 0

    return sorted((v, c, sum(x == c for x in comp.values()), layer(c)) for v, c in comp.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_layers(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:02}" for k in range(45)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(60)]
    edges += [(f"r{k:02}", f"r{(k + 1) % 23:02}") for k in range(23)] + [("r05", "n03"), ("n07", "r00"), ("x", "x"), ("x", "y")]  # a ring of 23, a loop
    df = spark.createDataFrame([*edges, *edges[:5], (None, "z")], "source string, target string")
    found = modules.components(df)
    got = found.join(modules.layers(df, found), "component").select("node", "component", "size", "layer")
    assert sorted(map(tuple, got.collect())) == slow_components(edges)


def test_no_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    found = modules.components(none)
    assert found.count() == 0 and modules.layers(none, found).count() == 0
