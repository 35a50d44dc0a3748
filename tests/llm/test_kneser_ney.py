"""The n-gram model against the textbook, and the classifier's verdicts against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from inkmill.llm import common, kneser_ney

TOKEN = re.compile("[^\x20\x09-\x0d]+")


def symbol(token):
    return xxhash.xxh64_intdigest(token.encode(), 42) & kneser_ney.MASK


def slow_symbols(text, order):
    """The operator's symbols of a text, after its openings."""
    return [0] * (order - 1) + [symbol(w) for w in TOKEN.findall(text)]


def slow_model(texts, order):
    """p(gram) by the textbook, from dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        s = slow_symbols(t, order)
        counts[order].update(tuple(s[k - order + 1 : k + 1]) for k in range(order - 1, len(s)))
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])

    def discounts(c):
        n = Counter(min(v, 5) for v in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0, 2 - 3 * y * n[3] / n[2] if n[2] else 0, 3 - 4 * y * n[4] / n[3] if n[3] else 0]
        return [min(max(d, 0), k) for k, d in enumerate(raw, 1)]

    d, total, off = {o: discounts(c) for o, c in counts.items()}, Counter(), Counter()
    for c in counts.values():
        for g, v in c.items():
            total[g[:-1]] += v
    for o, c in counts.items():
        for g, v in c.items():
            off[g[:-1]] += d[o][min(v, 3) - 1]

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / (1 << kneser_ney.SYMBOL_BITS)
        if not total[g[:-1]]:
            return low
        own = (counts[len(g)][g] - d[len(g)][min(counts[len(g)][g], 3) - 1]) / total[g[:-1]] if g in counts[len(g)] else 0
        return own + max(off[g[:-1]] / total[g[:-1]], 1e-9) * low

    return p


@pytest.mark.parametrize("order", [2, 3])
def test_surprise_against_the_textbook(spark, tmp_path, order):
    words = "the house by the river , was old and the people of the town knew it well . what is a house".split()
    texts = [" ".join(words[(k * 7 + j * (3 + k % 4)) % len(words)] for j in range(5 + k % 9)) for k in range(40)] + ["", "the the the", "old"]
    other = ["the river was old", "a town nobody knew", "xyz", "the", "", "people of the house , what is it well"] + texts[:5]
    trained = spark.createDataFrame([(t,) for t in texts], "text string")
    model = kneser_ney.train(trained, f"{tmp_path}/m", order)
    got = {r.k: r for r in kneser_ney.surprise(spark.createDataFrame(list(enumerate(other)), "k long, t string"), model, f"{tmp_path}/s").collect()}
    p = slow_model(texts, order)
    for k, t in enumerate(other):
        s = slow_symbols(t, order)
        want = -sum(math.log(p(tuple(s[j - order + 1 : j + 1]))) for j in range(order - 1, len(s)))
        assert (k in got) == bool(t) and (not t or (got[k].n == len(s) - order + 1 and math.isclose(got[k].surprise, want, rel_tol=1e-6))), (k, t)


@pytest.mark.parametrize("broadcast", [0, kneser_ney.BROADCAST_IDS])
def test_verdicts_against_a_plain_version(spark, sf_dir, monkeypatch, broadcast):
    """Perplexities by the textbook's model of the taught half; thresholds by quantiles of the other half's."""
    monkeypatch.setattr(kneser_ney, "BROADCAST_IDS", broadcast)
    docs, labels = common.table(spark, sf_dir, "documents").where("lang = 'en'"), common.table(spark, sf_dir, "labels")
    path = common.workspace(spark)
    docs = common.written(docs, f"{path}/docs")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    held = {r._trusted: r.held_out for r in kneser_ney.trusted_ids(labels).collect()}
    p = slow_model([texts[i] for i, h in held.items() if not h and i in texts], kneser_ney.ORDER)
    total, n = {}, {}
    for i, t in texts.items():
        s = slow_symbols(t, kneser_ney.ORDER)
        n[i] = len(s) - kneser_ney.ORDER + 1
        total[i] = -sum(math.log(p(tuple(s[j - kneser_ney.ORDER + 1 : j + 1]))) for j in range(kneser_ney.ORDER - 1, len(s)))
    got = {r.i: r for r in kneser_ney.verdicts(docs, labels, path).collect()}
    assert set(got) == set(texts)
    known = sorted(total[i] / n[i] for i, h in held.items() if h and n.get(i))
    middle = known[math.ceil(0.5 * len(known)) - 1]
    shrunk = {i: (total[i] + kneser_ney.PRIOR * middle) / (n[i] + kneser_ney.PRIOR) for i in texts if n[i]}
    most = math.exp(np.quantile([shrunk[i] for i, h in held.items() if h and n.get(i)], kneser_ney.HIGH, method="inverted_cdf")) * kneser_ney.MARGIN
    for i, t in texts.items():
        if n[i]:
            assert math.isclose(got[i].perplexity, math.exp(total[i] / n[i]), rel_tol=1e-5) and math.isclose(got[i].most, most, rel_tol=1e-5)
            assert got[i].kept == (math.exp(shrunk[i]) <= most)
        else:
            assert got[i].kept and got[i].perplexity is None
