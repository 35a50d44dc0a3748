import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from inkmill.llm import conversation_trie


def slow_trie(convs):
    """{conv_id: [(role, text)]} -> the nodes, told plainly."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    rows = []
    for p, ms in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        said = ",".join(map(str, sorted(ends[p])))
        rows.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids(p), sum(kids(q) == 0 for q in below), saved, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(map(str, rows))


def slow_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def dealt():
    rng, rows = random.Random(5), []
    for c in range(160):
        n = rng.choice([1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["", "aé", "bb b", "c" * 40])) for t in range(n)]
    rows += [(1000 + c, t, "user", "same") for c in range(300) for t in range(3)]  # copies over many partitions
    rows += [(5, None, None, None), (5, None, "user", "first"), (None, 1, "user", "no conversation"), (1700, 0, "user", "x")]
    return rows


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_against_brute_force(spark, partitions):
    rows = dealt()
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = got(conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.sequences(turns))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert found == slow_trie(slow_rebuilt(rows))


def test_turnless_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    # Conversation 103 has one turn, h of 103 is above 0, and conversation 100 is absent: some are left without turns.
    rows = [(c, 0, "user", "hello") for c in range(101, 112)]
    turns = spark.createDataFrame(rows, schema)
    want = slow_rebuilt(rows)
    assert any(not t for t in want.values())
    assert got(conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.sequences(turns)))) == slow_trie(want)
    none = spark.createDataFrame([], schema)
    assert conversation_trie.trie(conversation_trie.sequences(none)).count() == 0


def test_very_long_texts_and_conversations(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(700)] + [(2, t, "user", f"turn {t}") for t in range(690)] + [(3, 0, "user", "x" * 300_000), (4, 0, "user", "x" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = {(r.conv_id, r.depth): r for r in conversation_trie.trie(conversation_trie.sequences(turns)).collect()}
    assert len(nodes) == 702 and nodes[1, 0].n_convs == 4 and nodes[1, 0].n_leaves == 2
    assert nodes[3, 1].saved_tokens == 300_000 and nodes[1, 690].n_convs == 2 and nodes[1, 691].n_convs == 1


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(conversation_trie.op12_conversation_trie(spark, sf_dir)) == slow_trie(slow_rebuilt(rows))
