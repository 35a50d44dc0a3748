"""Sessions with expiry against a plain replay: late, repeated and expiring events over several batches."""

import random
from datetime import UTC, datetime, timedelta

from inkmill.streaming import state

SCHEMA = "event_id long, ts timestamp, user_id long, issue long, status string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def replay(events, ttl):
    """Sessions of each user, by gaps, over distinct events in the order of time."""
    out, by_user = [], {}
    for e in sorted({e[0]: e for e in events if e[1] is not None and e[2] is not None}.values(), key=lambda e: (e[1], e[0])):
        runs = by_user.setdefault(e[2], [])
        if not runs or e[1] - runs[-1][-1][1] >= ttl:
            runs.append([])
        runs[-1].append(e)
    for user, runs in by_user.items():
        for run in runs:
            last = {e[3]: e[4] for e in run if e[3] is not None and e[4] is not None}
            ms = lambda e: round(e[1].timestamp() * 1000)
            out.append((user, ms(run[0]), ms(run[-1]), len(run), len(last), sum(s in state.SETTLED for s in last.values())))
    return sorted(out)


def test_sessions_are_those_of_a_replay(spark, tmp_path):
    rng = random.Random(6)
    ttl, events, at = timedelta(minutes=20), [], START
    for k in range(160):
        at += timedelta(minutes=rng.choice([0, 1, 2, 9]))
        late = timedelta(minutes=rng.choice([0, 0, 3]))
        events.append((k, at - late, rng.randrange(5), rng.choice([None, 1, 2, 3]), rng.choice([None, "open", "accepted", "dismissed"])))
    batches = [events[k : k + 40] for k in range(0, 160, 40)]
    batches[1] = batches[1] + batches[1][:5]  # repeated within a batch
    batches[2] = [*batches[2], (900, None, 1, 1, "open"), (901, at, None, 1, "open")]
    end = [(999, at + timedelta(days=1), 99, None, None)]  # moves the watermark beyond every session
    too_late = [(998, START - timedelta(days=1), 1, 1, "open"), (997, at + timedelta(days=2), 98, None, None)]
    path = str(tmp_path / "events")
    for k, rows in enumerate([*batches, end, too_late]):
        spark.createDataFrame([tuple(r) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/b{k}")
    state.use_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    out = state.sessions(stream, int(ttl.total_seconds() * 1000), "5 minutes")
    query = out.writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = sorted(map(tuple, spark.table("ended").where("user_id < 90").collect()))
    assert got == replay(events, ttl) and any(r[5] for r in got) and len(got) > 10


class _Counted:
    """A state of one value or of a map, which counts the calls."""

    calls = 0

    def __init__(self):
        self.d = {}

    def __getattr__(self, name):
        def call(*args):
            _Counted.calls += 1
            if name in ("update", "updateValue"):
                self.d[args[0] if len(args) > 1 else None] = args[-1]
            elif name == "clear":
                self.d.clear()
            return {"exists": bool(self.d), "get": self.d.get(None), "iterator": list(self.d.items()), "containsKey": bool(args) and args[0] in self.d, "getValue": self.d.get(args[0]) if args else None, "listTimers": []}.get(name)

        return call


def test_sessions_within_a_batch_do_not_pass_through_the_state():
    """Each event made several calls; now only what is left open does."""
    import pandas as pd

    job = state.Sessions(100)
    job.handle = job.span = None
    job.handle, job.span, job.issues, job.seen = (_Counted() for _ in range(4))
    batch = lambda ids, step: pd.DataFrame({"at_ms": [i * step for i in ids], "event_id": list(ids), "issue": [i % 3 for i in ids], "status": ["open" if i % 2 else "resolved" for i in ids]})
    _Counted.calls = 0
    got = [tuple(r) for d in job.handleInputRows((7,), iter([batch(range(500), 200)]), None) for r in d.values.tolist()]
    assert got == [(7, 200 * i, 200 * i, 1, 1, int(i % 2 == 0)) for i in range(499)] and _Counted.calls < 20
    # The open session goes on in the next batch: an event again, a new one in time, one that ends it.
    later = pd.DataFrame({"at_ms": [99_800, 99_850, 100_000], "event_id": [499, 900, 901], "issue": [1, 5, 6], "status": ["open", "accepted", "open"]})
    assert [tuple(r) for d in job.handleInputRows((7,), iter([later]), None) for r in d.values.tolist()] == [(7, 99_800, 99_850, 2, 2, 1)]
