"""The contextual bootstrap against a plain version, and what it finds among planted identifiers."""

import math
import re
from collections import defaultdict

import pytest
from test_others import BASE, base_spans

from inkmill.llm import pii

SECRET = re.compile(r"(?<![a-z0-9+/_=-])[a-z0-9+/_-]{16,}", re.I)
NAMED = re.compile(r"(?:token|secret|passwd|password|api_key|apikey|api-key)[\"']? ?[=:] ?[\"']?$", re.I)
TOKEN = re.compile(r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z0-9@._+-]{6})[A-Za-z._+-]*[0-9@][A-Za-z0-9@._+-]*")
GROUP = re.compile(r"(?<![0-9])(?<![0-9][\x20-])[0-9]+(?:[\x20-][0-9]+)+")
KINDS = [k for k, _, _ in BASE] + ["secret"]


def apart(a, spans):
    return all(b[1] <= a[0] or a[1] <= b[0] for b in spans)


def occurrences(text):
    """(start, end, kind or None, patterns) of seeds and candidates."""
    seeds = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(text).split(",") if x)]
    seeds += [(m.start(), m.end(), "secret") for m in SECRET.finditer(text) if NAMED.search(text[: m.start()]) and apart(m.span(), seeds)]
    groups = [m.span() for m in GROUP.finditer(text) if len(re.sub("[^0-9]", "", m[0])) >= 7 and apart(m.span(), seeds)]
    tokens = [m.span() for m in TOKEN.finditer(text) if apart(m.span(), seeds) and apart(m.span(), groups)]
    plain = lambda s: re.sub("[0-9]+", "0", s.lower())
    for a, b, k in seeds + [(a, b, None) for a, b in tokens + groups]:
        left, right, hit = text[:a].split(), text[b:].split(), text[a:b]
        l2, l1, r1 = plain(left[-2]) if len(left) > 1 else "", plain(left[-1]) if left else "", plain(right[0]) if right else ""
        shape = re.sub("[0-9]+", "0", re.sub("[A-Za-z]+", "a", hit))
        yield a, b, k, hit, ((0, l2, l1), (1, l1, r1), (2, l1, shape))


def slow_spans(texts):
    """All spans of each text: base, secrets and discovered."""
    found = {i: list(occurrences(t)) for i, t in texts.items()}
    n, total, kinds = defaultdict(int), defaultdict(int), set()
    for rows in found.values():
        for _, _, k, hit, patterns in rows:
            for p in patterns:
                n[p, hit, k] += 1
                total[p] += 1
    scores = {}
    for r in range(pii.ROUNDS + 1):
        doubt = defaultdict(float)
        for (p, hit, k), _ in n.items():
            if k is None:
                for kind in KINDS:
                    if (p, kind) in scores:
                        doubt[hit, kind] += math.log1p(-min(scores[p, kind], 0.999999))
        mass, support = defaultdict(float), defaultdict(int)
        for (p, hit, k), m in n.items():
            if k is not None:
                mass[p, k] += m
                support[p, k] += 1
            else:
                for kind in KINDS:
                    if (hit, kind) in doubt:
                        own = math.log1p(-min(scores[p, kind], 0.999999)) if (p, kind) in scores else 0
                        score = 1 - math.exp(doubt[hit, kind] - own)
                        mass[p, kind] += m * score
                        support[p, kind] += score >= pii.SURE
        scores = {(p, kind): v / (total[p] + pii.SMOOTH) for (p, kind), v in mass.items() if v / (total[p] + pii.SMOOTH) >= pii.TRUST and support[p, kind] >= pii.SEEDS}
    out = {}
    for i, rows in found.items():
        spans = []
        for a, b, k, _, patterns in rows:
            best = max(((scores[p, kind], -KINDS.index(kind)) for p in patterns for kind in KINDS if (p, kind) in scores), default=None)
            if k or best:
                spans.append((a, KINDS.index(k) if k else -best[1], b))
        out[i] = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return out


def spans_of(spark, texts, tmp_path):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    rows = pii.find(spark.read.parquet(f"{tmp_path}/d"), ["doc_id"]).select("row.doc_id", pii.written_spans("spans").alias("s")).collect()
    return {r.doc_id: r.s for r in rows}


def test_table_against_the_plain_version(spark, sf_dir, texts):
    want = slow_spans(texts)
    assert {r.doc_id: r.spans for r in pii.op3_pii(spark, sf_dir).collect()} == want


@pytest.fixture(scope="module")
def planted():
    """Identifiers that no base pattern knows, after words that base ones have; then such after words that only found ones have."""
    texts, hidden = {}, {}
    for k in range(40):
        texts[k] = f"Reach us, Tel: +49 30 {1234000 + 7 * k} in the day. Mail: user{k}@example{k}.org for more."
    for k in range(40, 60):
        hidden[k] = (f"030 {7654000 + 11 * k}", "phone")
        texts[k] = f"Reach us, Tel: {hidden[k][0]} in the day. Nothing else here."
    for k in range(60, 80):
        hidden[k] = (f"jane.{chr(97 + k % 20)}@intranet", "email")
        texts[k] = f"So it was. Mail: {hidden[k][0]} for more."
    for k in range(80, 100):  # the same numbers in a context without seeds
        texts[k] = f"Now ring desk number {hidden[40 + k % 20][0]} please, thanks."
    for k in range(100, 110):  # numbers seen nowhere else, in that context
        hidden[k] = (f"0800 {5550000 + 13 * k}", "phone")
        texts[k] = f"Now ring desk number {hidden[k][0]} please, thanks."
    for k in range(110, 120):
        texts[k] = f"In the year 2020 part 77-{1000 + k}-{2000 + k} was sold, release 1.2.{k} came out."
    token = lambda k: f"{k:02x}" + "0a1b2c3d4e5f6071"
    for k in range(120, 130):
        texts[k] = f"config token = {token(k)} end of line"
    for k in range(130, 135):
        hidden[k] = (f"hun7er{k}", "secret")
        texts[k] = f"config token = {hidden[k][0]} end of line"
    return texts, hidden


def test_planted_identifiers_are_found(spark, planted, tmp_path):
    texts, hidden = planted
    got = spans_of(spark, texts, tmp_path)
    assert got == slow_spans(texts)
    caught = sum(f"{kind}:{texts[k].index(value)}:{texts[k].index(value) + len(value)}" in got[k] for k, (value, kind) in hidden.items())
    assert caught / len(hidden) >= 0.9
    assert not any(got[k] for k in range(110, 120))


def test_words_longer_than_the_near_look(spark, tmp_path):
    texts = {k: "x" * 200 + f" call {'y' * 100} +49 30 {1234000 + k} {'z' * 100} end" for k in range(6)} | {9: "x" * 200 + f" call {'y' * 100} 030 7654321 {'z' * 100} end"}
    got = spans_of(spark, texts, tmp_path)
    assert got == slow_spans(texts) and got[9].startswith("phone:")


def test_extra_columns_of_odd_names(spark, tmp_path):
    spark.createDataFrame([(1, "mail a.b@example.com now", "x", "y", "z"), (None, None, None, None, None)], "doc_id long, text string, `a b` string, `a.b` string, t string").write.parquet(f"{tmp_path}/d")
    out = pii.redact(spark.read.parquet(f"{tmp_path}/d"))
    assert out.columns == ["doc_id", "text", "a b", "a.b", "t"]
    assert {tuple(r) for r in out.collect()} == {(1, "mail [EMAIL] now", "x", "y", "z"), (None,) * 5}
