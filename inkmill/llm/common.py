"""Shared plumbing of the llm operators: the shared folder, written tables, row packing and batch sizes."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Rows in an Arrow batch: with the longest texts of a few hundred kB a batch stays within some tens of MB.
BATCH_ROWS = 256

#: Numbers of so many files at most are broadcast.
BROADCAST_FILES = 200_000

_shipped: set[str] = set()
#: Where set, workspaces are noted, for whoever deletes them.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def _alone(spark: SparkSession) -> bool:
    """Whether the master is local, driver and executor in one process; local-cluster has executors of its own."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def workspace(spark: SparkSession) -> str:
    """A fresh folder below the one that all executors share (spark.checkpoint.dir).

    Only on a local master, as in tests, a folder of this machine stands in where that setting is absent.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="inkmill-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/inkmill-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return path


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Workspaces made inside are added to paths."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    df.write.mode("error").option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that later steps no longer read."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not when the driver next happens to collect its garbage.

    On a local master, with its small inputs, they wait for that.
    """
    if _alone(spark):
        return
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works beside this thread


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever the driver found it; and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="inkmill-ship-"), "inkmill_ship.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of this very name, dots, blanks and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def text_of(col: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(named(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; none for a blank text.

    Texts whose blanks are spaces and line ends only, nearly all, are split at a plain sign, others by way of a translation.
    """
    plain = F.when(text.rlike("[\\x09\\x0B-\\x0D]"), F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(plain, " "), "")


def numbered(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The given columns and k, a number of each row that holds in every read of docs, however a read is split into tasks.

    For the read of Parquet files, the place of the row: its file's number by path, then its place in the file, which the
    reader tells. Anything else is numbered and written once, and the written table is what comes back.
    """
    spark = docs.sparkSession
    named_ = [c.alias(name) for name, c in columns.items()]
    try:
        place = docs.metadataColumn("_metadata")
        placed = docs.select(place["file_path"].alias("_file"), place["row_index"].alias("_row"), *named_)
    except AnalysisException:
        return written(docs.select(F.monotonically_increasing_id().alias("k"), *named_), f"{workspace(spark)}/numbered")
    # A row for each file; no column of the table is read for it.
    paths = docs.select(place["file_path"].alias("_file")).distinct()
    files = written(paths.select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_number")), f"{workspace(spark)}/files")
    files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
    return placed.join(files, "_file").select((F.shiftleft("_number", 40) + F.col("_row")).alias("k"), *columns)


def packed(df: DataFrame) -> Column:
    """Every column of df in one struct, so that names which an operator uses cannot clash with the caller's."""
    return F.struct(*[named(c).alias(c) for c in df.columns])
