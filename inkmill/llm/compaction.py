"""Sharding by size-tiered compaction, in DataFrame functions only.

A store is a folder: `data/<run>/` holds the immutable Parquet shards of one append or merge, `manifest/v<n>` lists the
shards of version n. `append` writes arrivals as small shards and commits a version with them. `compact` takes the
shards below TARGET bytes, groups them by size tier (powers of FANOUT), and merges each tier that has FANOUT shards or
more into files of about TARGET bytes; smaller tiers wait. A merge reads whole small files and writes them again without
a shuffle: shards of one tier are alike in size, so as many per task give files alike in size.

A version is committed by giving a finished pointer file its final name, which fails if another writer's file has it: on
a local file system by a hard link, elsewhere by creating the file if there is none of its name. That is safe where such a
create is exclusive (HDFS, ABFS, GCS, and S3 by way of conditional puts); other stores must not have two writers at once.
The pointer also holds the version's schema. The loser tries again on top of the newer version: an append adds its shards there, a merge replaces its shards there, and gives up (its files are never
read) if another merge has taken one of them meanwhile. Readers open the newest version's manifest. Lost executors
repeat tasks; Spark's own commit keeps one copy of each file. As with any scan of files, the driver holds the list of a
version's shards: one path for TARGET bytes.

Arrivals may have more columns than the store, or fewer: a version's schema has all that ever came, by name without regard
to case, and a row has null where its arrival had no such column. A column of another type is refused before anything is
written. Rows keep all of their columns, whatever their names, with nulls, empty and long texts, ties and repeated rows as they
are; an empty arrival commits a version without new shards, and a store of empty arrivals reads as an empty table of
their columns.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common

#: Half seconds that a reader waits for a pointer that is being written.
WAITS = 60
TARGET = 32 << 20
FANOUT = 4
SMALLEST = 64 << 10
MANIFEST = "path string, bytes long, rows long, tier int, born int"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version, 0 for none."""
        at = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[1:]) for n in names if n[0] == "v"), default=0)

    def _pointer(self, version: int) -> tuple[str, StructType]:
        """The manifest folder and the schema of a version. Its writer may still be at it: the last line ends with a line end."""
        for _ in range(WAITS):
            stream = self._fs.open(self._path(f"{self.root}/manifest/v{version}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                name, schema = text.splitlines()
                return name, StructType.fromJson(json.loads(schema))
            time.sleep(0.5)
        raise OSError(f"version {version} of {self.root} was begun and not finished; delete its pointer file to go on")

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{self._pointer(version)[0]}")

    def schema(self, version: int | None = None) -> StructType:
        """All columns of a version's rows, each nullable."""
        version = self.version() if version is None else version
        return self._pointer(version)[1] if version else StructType()

    @staticmethod
    def _widened(schema: StructType, more: StructType) -> StructType:
        fields = {f.name.lower(): f for f in schema}
        for f in more:
            known = fields.setdefault(f.name.lower(), StructField(f.name, f.dataType, True))
            if known.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, but {known.dataType.simpleString()} in the store")
        return StructType(list(fields.values()))

    def _claim(self, version: int, name: str, schema: StructType) -> bool:
        """Point version at the manifest folder `name`; False if the version is there already."""
        text, target = bytearray(f"{name}\n{schema.json()}\n".encode()), self._path(f"{self.root}/manifest/v{version}")
        taken = lambda e: "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception)
        if self._fs.getScheme() != "file":
            try:
                out = self._fs.create(target, False)
            except Py4JJavaError as e:
                if not taken(e):
                    raise
                return False
            out.write(text)
            out.close()
            return True
        draft = self._path(f"{self.root}/manifest/.pointer-{name}-{version}")
        out = self._fs.create(draft, True)
        out.write(text)
        out.close()
        jvm = self.spark._jvm
        path = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI("file", None, p.toUri().getPath(), None))
        try:
            jvm.java.nio.file.Files.createLink(path(target), path(draft))
        except Py4JJavaError as e:
            if not taken(e):
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True

    def _commit(self, change: Callable[[DataFrame, int], DataFrame | None], arrived: StructType | None = None) -> int:
        """Commit change(newest manifest, new version) as the next version, again on each newer one until it holds.

        A change of None is given up; the newest version comes back. arrived: columns that the version has besides.
        """
        while True:
            seen = self.version()
            schema = self._widened(self.schema(seen), arrived or StructType())
            after = change(self.manifest(seen), seen + 1)
            if after is None:
                return seen
            name = f"m-{uuid.uuid4().hex}"
            after.coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
            if self._claim(seen + 1, name, schema):
                return seen + 1

    def _written(self, run: str, born: int) -> DataFrame:
        """The shards of a run: name, bytes and rows of each file."""
        files = self.spark.read.parquet(run).select("_metadata.file_path", "_metadata.file_size")
        found = files.groupBy(F.col("file_path").alias("path"), F.col("file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        tier = F.floor(F.log(float(FANOUT), F.greatest(F.col("bytes"), F.lit(SMALLEST)) / SMALLEST)).cast("int")
        return found.select("path", "bytes", "rows", tier.alias("tier"), F.lit(born).alias("born"))

    def append(self, arrivals: DataFrame) -> int:
        """Write arrivals as they are dealt, one small shard a task, and commit them."""
        self._widened(self.schema(), arrivals.schema)
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").parquet(run)
        return self._commit(lambda before, born: before.unionByName(self._written(run, born)), arrivals.schema)

    def compact(self) -> int:
        """Merge every tier of FANOUT or more shards below TARGET; returns the version, unchanged if nothing merges."""
        seen = self.version()
        schema = self.schema(seen)
        small = self.manifest(seen).where(F.col("bytes") < TARGET)
        # A row for each tier: as many as the powers of FANOUT below TARGET.
        tiers = small.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        tiers = tiers.where(f"n >= {FANOUT} AND ceil(bytes / {TARGET}) < n").orderBy("tier").collect()
        runs = []
        for t in tiers:
            paths = [r.path for r in small.where(F.col("tier") == t.tier).select("path").toLocalIterator()]
            runs.append(f"{self.root}/data/{uuid.uuid4().hex}")
            merged = self.spark.read.schema(schema).parquet(*paths).coalesce(max(1, math.ceil(t.bytes / TARGET)))
            # Where a task reads more than TARGET, it writes several files.
            merged.write.option("compression", "zstd").option("maxRecordsPerFile", math.ceil(1.5 * t.rows * TARGET / t.bytes)).parquet(runs[-1])
        if not tiers:
            return seen
        gone = small.where(F.col("tier").isin([t.tier for t in tiers])).select("path")

        def replaced(before: DataFrame, born: int) -> DataFrame | None:
            if gone.join(before, "path", "left_anti").head() is not None:
                return None
            after = before.join(gone, "path", "left_anti")
            for run in runs:
                after = after.unionByName(self._written(run, born))
            return after

        return self._commit(replaced)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version with `shard`, the file each one lies in."""
        version = self.version() if version is None else version
        paths, schema = [r.path for r in self.manifest(version).select("path").toLocalIterator()], self.schema(version)
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.withColumn("shard", F.col("_metadata.file_path"))


#: Arrivals of the query: shares of the rows by hash of the id, in 16ths; the first is a backfill.
ARRIVALS = (8, 4, 2, 1, 1)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents arrive in five parts, are compacted to the end, and are read back with their shards."""
    docs = common.table(spark, sf_dir, "documents")
    root = f"{common.workspace(spark)}/store"
    store = Store(spark, root)
    slot, at = F.pmod(F.xxhash64("doc_id"), F.lit(16)), 0
    for share in ARRIVALS:
        store.append(docs.where((slot >= at) & (slot < at + share)))
        at += share
    v = store.version()
    while v != (v := store.compact()):  # each round leaves fewer shards
        pass
    shards = store.manifest(v).select(F.col("path").alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "tier", F.col("born").alias("version"))
    rows = store.read(v).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard")
    return rows.join(shards, "shard").select("doc_id", "n_bytes", F.regexp_extract("shard", "part-(\\d+)", 1).alias("shard"), "shard_bytes", "shard_rows", "tier", "version")
