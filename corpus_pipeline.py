"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import common, kneser_ney, line_dedup, packing, pii, simhash


#: Workspaces of the last stage that was called by itself, for the next one to delete.
_last: list[str] = []


def _staged(stage):
    """A stage that first deletes what the stage before it left.

    The result of that one has been written when this one begins. Only workspaces of stages are touched; run() keeps
    a list of its own, so that two runs, or a run and stages called by themselves, do not meet.
    """

    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str, left: list[str] | None = None) -> DataFrame:
        left = _last if left is None else left
        while left:
            common.forget(spark, left.pop())
        common.release(spark)
        with common.noting(left):
            return stage(spark, docs, sf_dir)

    return begin


@_staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is over their language's threshold go.

    Rows of null, empty or blank text stay, as do all rows where no document is trusted; repeated rows share a verdict; a
    null language is one of its own; an empty table gives no rows; other columns come back unchanged, whatever their names.
    """
    found = kneser_ney.classify(docs, common.table(spark, sf_dir, "labels"), common.workspace(spark))
    return found.where("kept").select("row.*")


@_staged
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier line go; n_chars follows the text.

    No row goes: texts that lose every line are empty; null and empty texts stay as they are (n_chars null and 0); of
    repeated rows the first read keeps its lines; null ids come first; an empty table gives no rows; other columns come
    back unchanged, whatever their names.
    """
    return line_dedup.dedupe(docs).withColumn("n_chars", F.length("text").cast("long"))


@_staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays, the one with the least doc_id.

    Texts without words (null, empty, blank) are one group; of repeated rows the first read stays; null ids give way to
    others; an empty table gives no rows; other columns come back unchanged, whatever their names.
    """
    return simhash.keep_one(docs)


@_staged
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text.

    No row goes; null and empty texts stay as they are (n_chars null and 0); repeated rows are treated alike, null ids
    do not matter; an empty table gives no rows; other columns come back unchanged, whatever their names.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@_staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 ids.

    A null or empty text is a piece of the end id alone; repeated rows and rows of null ids are packed as often as they
    occur; an empty table gives no pieces; columns other than doc_id and text are not looked at, whatever their names.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near-duplicates", near_duplicates),
    ("personal-data", personal_data),
    ("packing", packed),
]

#: Perplexities, similarity joins and packing cannot be told in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES in turn to documents. The last result is read from a table of the run's own; the others are deleted."""
    docs, path, left = common.table(spark, sf_dir, "documents"), common.workspace(spark), []
    for k, (name, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir, left), f"{path}/{k}-{name}")
        if k:
            common.forget(spark, f"{path}/{k - 1}-{STAGES[k - 1][0]}")
    while left:
        common.forget(spark, left.pop())
    return docs
