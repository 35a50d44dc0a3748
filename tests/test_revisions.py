"""Incremental runs against full ones, and the fold against every subsequence."""

import random
from itertools import combinations

from inkmill.operators import revisions as V
from inkmill.plans import spans


def longest(xs):
    return next((n for n in range(len(xs), 0, -1) if any(list(c) == sorted(set(c)) for c in combinations(xs, n))), 0)


def test_blocks_in_order_are_a_longest_run(spark):
    rng = random.Random(1)
    shapes = [rng.sample(range(30), n) for n in (1, 2, 5, 9, 11)] + [list(range(12)), list(range(12))[::-1]]
    rows = [(d, old, new, 0) for d, olds in enumerate(shapes) for new, old in enumerate(olds)]
    got = V.aligned(spark.createDataFrame(rows, "doc_id long, old_idx int, new_idx int, shift long")).collect()
    assert len(got) == len(rows)
    for d, olds in enumerate(shapes):
        stay = [r.old_idx for r in sorted(got, key=lambda r: r.new_idx) if r.doc_id == d and not r.moved]
        assert stay == sorted(stay) and len(stay) == longest(olds)


def test_what_is_matched(spark):
    old = [(1, 0, "p", "a"), (1, 1, "p", "b"), (1, 2, "p", "a"), (1, 3, "h", "a"), (1, 4, None, None), (2, 0, "p", "gone")]
    new = [(1, 0, "p", "b"), (1, 1, "p", "a"), (1, 2, "p", "a"), (1, 3, "p", "a"), (1, 4, None, ""), (1, 5, "pa", ""), (3, 0, "p", "gone")]
    tables = [V.snapshot(spark.createDataFrame(rows, "doc_id long, block_idx int, block_type string, content string")) for rows in (old, new)]
    assert sorted((r.old_idx, r.new_idx, r["shift"]) for r in V.matched(*tables).collect()) == [(0, 1, 2), (1, 0, -2), (2, 2, 0), (4, 4, 0)]


def test_a_rerun_is_a_full_run_and_analyses_only_what_changed(spark, sf_dir):
    old, new = (V.snapshot(v).cache() for v in spans._versions(spark, sf_dir))
    seen = []

    def analyse(blocks):
        seen.append(blocks.count())
        return spans._block_finds(blocks)

    got = V.rerun(old, new, spans._block_finds(old), analyse)
    full = spans._block_finds(new)
    assert sorted(map(str, got.drop("carried").collect())) == sorted(map(str, full.collect()))
    assert 0 < seen[0] < new.count() / 2 and got.where("carried").count() > got.where("NOT carried").count() > 0
    none = new.where("false")
    assert V.rerun(none, new, spans._block_finds(none), spans._block_finds).count() == full.count() and V.rerun(old, none, spans._block_finds(old), spans._block_finds).count() == 0
