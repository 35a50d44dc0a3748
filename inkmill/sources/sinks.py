"""Sinks: issue tables by run, feedback log, session upserts, and the report as HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(issues: DataFrame, path: str, run_id: str, partial: bool) -> None:
    """One phase of a run; the final phase takes the partial one's place for readers."""
    issues.withColumn("run_id", F.lit(run_id)).withColumn("phase", F.lit("partial" if partial else "final")).write.mode("append").partitionBy("run_id", "phase").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The final issues of a run, the partial ones until then."""
    found = spark.read.parquet(path).where(F.col("run_id") == run_id)
    final = found.where("phase = 'final'")
    return final if not final.isEmpty() else found.where("phase = 'partial'")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and old's that new has no key of."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.select("session_id", "issue_id", "rule_type", "thumbs_up", "comment", F.coalesce("created_at", F.current_timestamp()).alias("created_at")).write.mode("append").parquet(path)


def report_html(score: int, label: str, counts: dict[str, int], actions: list[str]) -> str:
    """A document's report page."""
    rows = "".join(f"<tr><td>{html.escape(k)}</td><td>{v}</td></tr>" for k, v in sorted(counts.items()))
    todo = "".join(f"<li>{html.escape(a)}</li>" for a in actions)
    return f"<html><body><h1>{score} ({html.escape(label)})</h1><table>{rows}</table><ol>{todo}</ol></body></html>"
