"""Plumbing of operators that run in rounds: each round's table goes to the checkpoint folder, so plans stay short.

Tables are written and read back as Parquet: Spark's own checkpoint computes its last stage twice, once to count the rows,
and its rows have no size that Spark could plan the next round by.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df by way of the folder in spark.checkpoint.dir; only a local master without it gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="inkmill-rounds-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
