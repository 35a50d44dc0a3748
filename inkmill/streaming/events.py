"""Structured Streaming: sessions, windows, expiry, cancelling and rescoring over a stream of status events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATE = "10 minutes"


def events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 8).parquet(folder)


def tumbling(stream: DataFrame, size: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sliding(stream: DataFrame, size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions end after a gap without events: expiry by time to live."""
    return stream.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def fresh(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark: a block cache with expiry."""
    return stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def rescored(stream: DataFrame) -> DataFrame:
    """(user_id, open, score) after each batch: the last status of each issue is state, a dismissal raises the score."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open = dict(zip(*state.get, strict=True)) if state.exists else {}
        for pdf in batches:
            for r in pdf.sort_values("event_id").itertuples():
                is_open[int(r.event_id) % 97] = r.event_type not in ("error", "purchase", "signup")
        state.update((list(is_open), list(is_open.values())))
        n = sum(is_open.values())
        yield pd.DataFrame({"user_id": [key[0]], "open": [n], "score": [max(30, 100 - n)]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, open int, score int", "issue array<long>, is_open array<boolean>", "update", GroupStateTimeout.NoTimeout)


def two_phase(stream: DataFrame, path: str, checkpoint: str):
    """Each batch's rows are written at once, keyed by the batch; a repeated batch overwrites its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
