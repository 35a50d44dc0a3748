"""Operators that join rows back to a second read give the same rows when the read is split otherwise between call and action."""

import pytest
from pyspark.sql import functions as F

from inkmill.llm import common, kneser_ney, line_dedup, simhash


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "documents.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4).write.option("parquet.block.size", 4096).parquet(path)
    return path


@pytest.fixture()
def resplit(spark, files):
    """Makes a frame, changes how tables are split, and collects it."""

    def run(make):
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        try:
            spark.conf.set("spark.sql.files.minPartitionNum", "4")
            frame = make(spark.read.parquet(files))
            spark.conf.set("spark.sql.files.minPartitionNum", "16")
            return sorted(map(str, frame.collect()))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.unset("spark.sql.files.openCostInBytes")

    return run


def test_numbers_hold(spark, files, resplit):
    steady = sorted(map(str, common.numbered(spark.read.parquet(files), {"doc_id": F.col("doc_id")}).collect()))
    assert resplit(lambda docs: common.numbered(docs, {"doc_id": F.col("doc_id")})) == steady and len(set(steady)) == len(steady)


def test_lines(spark, files, resplit):
    steady = sorted(map(str, line_dedup.dedupe(spark.read.parquet(files)).collect()))
    assert resplit(line_dedup.dedupe) == steady


def test_near_copies(spark, files, resplit):
    steady = sorted(map(str, simhash.keep_one(spark.read.parquet(files)).collect()))
    assert resplit(simhash.keep_one) == steady


def test_quality(spark, sf_dir, files, resplit):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # Sums of logarithms may differ in their last digits.
    classify = lambda docs: kneser_ney.classify(docs, labels, common.workspace(spark)).select("row", "n_tokens", F.round("perplexity", 5), F.round("most", 5), "kept")
    rows = classify(spark.read.parquet(files)).collect()
    assert len(rows) == spark.read.parquet(files).count() and sorted(map(str, rows)) == resplit(classify)


def test_rows_without_files_are_written_once(spark):
    some = spark.range(100).select(F.col("id").alias("doc_id"), F.rand().alias("x"), F.lit("a").alias("_metadata"))
    rows = common.numbered(some, {"doc_id": F.col("doc_id"), "x": F.col("x")})
    assert rows.collect() == rows.collect() and rows.select("k").distinct().count() == 100
