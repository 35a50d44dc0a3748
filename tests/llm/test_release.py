"""Shuffle files are dropped wherever executors have folders of their own; a rare word's symbol is no opening."""

import itertools
from types import SimpleNamespace

import pytest
import xxhash

from inkmill.llm import common, kneser_ney


@pytest.mark.parametrize("master, collected", [("local", 0), ("local[4]", 0), ("local-cluster[3,2,3000]", 2), ("spark://host:7077", 2), ("yarn", 2)])
def test_release_collects_but_on_one_process(monkeypatch, master, collected):
    calls = []
    jvm = SimpleNamespace(System=SimpleNamespace(gc=lambda: calls.append(1)))
    monkeypatch.setattr(common.time, "sleep", lambda s: None)
    common.release(SimpleNamespace(sparkContext=SimpleNamespace(master=master, _jvm=jvm)))
    assert len(calls) == collected


def test_an_opening_is_not_predicted(spark, tmp_path):
    """A word may have the opening's symbol 0; texts without it have the same surprise as by the textbook."""
    from test_kneser_ney import slow_model, slow_symbols
    import math

    zero = next(w for k in itertools.count() if not xxhash.xxh64_intdigest(w := f"w{k}".encode(), 42) & kneser_ney.MASK).decode()
    texts = [f"the house {zero} old", f"old {zero} river", "the river was old"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), f"{tmp_path}/m")
    got = kneser_ney.surprise(spark.createDataFrame([(1, "the river"), (2, "was")], "k long, t string"), model, f"{tmp_path}/s").collect()
    p = slow_model(texts, 2)
    for r in got:
        s = slow_symbols({1: "the river", 2: "was"}[r.k], 2)
        assert math.isclose(r.surprise, -sum(math.log(p(tuple(s[j - 1 : j + 1]))) for j in range(1, len(s))), rel_tol=1e-6)
