"""Documents of few issues are folded in one step, with the same result as by rounds."""

import random

import pytest

from inkmill.operators import tiers

COLUMNS = "doc_id long, ord int, source string, category string, flagged string, start int, `end` int, confidence double"


def issues(spark, sources, seed):
    rng = random.Random(seed)
    words = ["the", "cat", "Cat", "sat", "on", "mat", " ", ""]
    rows = []
    for d in range(12):
        for o in range(rng.choice([1, 3, 25])):
            start = rng.randrange(60)
            span = (start, start + rng.randrange(1, 15)) if rng.random() < 0.8 else (0, 0)
            rows.append((d, o, rng.choice(sources), rng.choice(["style", "grammar", "punctuation", None]), " ".join(rng.choices(words, k=rng.randrange(1, 4))), *span, rng.random()))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_are_as_rounds(spark, monkeypatch, seed):
    parts = [issues(spark, s, seed + n) for n, s in enumerate((["rules"], ["checker"], ["granular", "global"]))]
    result = lambda: (sorted(map(str, tiers.dedup_model(parts[2]).collect())), sorted(map(str, tiers.merge_tiers(*parts).collect())))
    folded = result()
    monkeypatch.setattr(tiers, "FOLD", 10)
    some = result()
    monkeypatch.setattr(tiers, "FOLD", 0)
    assert folded == some == result() and 0 < len(folded[0]) < parts[2].count()


def test_few_issues_need_no_rounds(spark, monkeypatch):
    def no(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(tiers, "first_kept", no)
    assert tiers.dedup_model(issues(spark, ["granular", "global"], 3)).count()
