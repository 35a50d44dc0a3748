"""Review sessions as keyed state with expiry: what a session holds is kept until TTL after its last event, then let go.

A session keeps the status of each of its issues (map state) and its own span (value state). An event-time timer stands at
its last event plus TTL; when the watermark passes it, the session's summary is given out and its state cleared. An event
that comes at or after the expiry of the session before it begins a new one, even if the timer has not run yet. Repeated
events (one event id) count once. Events older than the watermark are dropped by Spark.

Events with a null user or time are left out; a null issue or status is an event that touches no issue; issues are counted
by their last status in the order of time, then of the event's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds that a session lives after its last event.
TTL = 3_600_000
OUT = "user_id long, first_ms long, last_ms long, events long, issues long, settled long"
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]
#: Statuses after which an issue needs no more work.
SETTLED = ("accepted", "dismissed", "resolved")


class Sessions(StatefulProcessor):
    def __init__(self, ttl: int = TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "first_ms long, last_ms long, events long")
        self.issues = handle.getMapState("issues", "issue long", "at_ms long, event_id long, status string")
        self.seen = handle.getMapState("seen", "event_id long", "at_ms long")

    def _summary(self, user: int, span: tuple, issues: dict) -> tuple:
        return (user, *span, len(issues), sum(v[2] in SETTLED for v in issues.values()))

    def _held(self) -> dict:
        return {int(k[0]): tuple(v) for k, v in self.issues.iterator()}

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for state in (self.span, self.issues, self.seen):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A batch's rows of one user, in the order of time. The state is asked only about the session that it holds, and
        # takes what is left open: sessions that begin and end within the batch never reach it.
        user, ended = int(key[0]), []
        events = pd.concat(list(rows)).sort_values(["at_ms", "event_id"], kind="stable")
        stored = self.span.exists()
        span, issues, seen = (tuple(self.span.get()) if stored else None), {}, {}
        columns = (events[c].tolist() for c in ("at_ms", "event_id", "issue", "status"))
        for at, event, issue, status in zip(*columns, strict=True):
            if span is not None and at >= span[1] + self.ttl:
                ended.append(self._summary(user, span, self._held() | issues if stored else issues))
                if stored:
                    self._forget()
                stored, span, issues, seen = False, None, {}, {}
            if event in seen or (stored and self.seen.containsKey((event,))):
                continue
            seen[event] = at
            first, last, n = span or (at, at, 0)
            span = (min(first, at), max(last, at), n + 1)
            if pd.notna(issue) and pd.notna(status):
                issue = int(issue)
                old = issues.get(issue)
                if old is None and stored and self.issues.containsKey((issue,)):
                    old = tuple(self.issues.getValue((issue,)))
                if old is None or old[:2] <= (at, event):
                    issues[issue] = (at, event, status)
        if span is not None and seen:
            self.span.update(span)
            for issue, value in issues.items():
                self.issues.updateValue((issue,), value)
            for event, at in seen.items():
                self.seen.updateValue((event,), (at,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(span[1] + self.ttl)
        if ended:
            yield pd.DataFrame(ended, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.span.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.span.get()[1] + self.ttl:
            out = self._summary(int(key[0]), tuple(self.span.get()), self._held())
            self._forget()
            yield pd.DataFrame([out], columns=NAMES)

    def close(self) -> None:
        pass


def sessions(events: DataFrame, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """Summaries (OUT) of ended sessions of a stream of events (event_id, ts, user_id, issue, status).

    The session must use the RocksDB state store (`use_rocksdb`).
    """
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    told = rows.select("user_id", "event_id", "ts", F.unix_millis("ts").alias("at_ms"), "issue", "status")
    return told.groupBy("user_id").transformWithStateInPandas(Sessions(ttl), OUT, "Append", "EventTime")


def use_rocksdb(spark) -> None:
    """The state store that keyed state needs. The session's manager of streams keeps its register, so it is begun here for batches too."""
    _ = spark.streams.active
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
