"""Queries of the sources: formats, parsers, chunks and content types over whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content
from ..sources import connectors, parse
from . import duck


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("page").alias("kind"))
    return pages.unionByName(_docs(spark, sf_dir).withColumn("kind", F.lit("document"))).transform(content.with_file_format).select("kind", "doc_id", "file_type")


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.with_content_type(_docs(spark, sf_dir)).select("doc_id", "content_type")


def plaintext_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.plaintext(_docs(spark, sf_dir))


def parsed(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.blocks(_docs(spark, sf_dir), kind)


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.chunks(_docs(spark, sf_dir))


def no_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.check(_docs(spark, sf_dir))


def _votes(votes: tuple, order: tuple, text: str) -> dict[str, str]:
    return {t: " + ".join(f"(CASE WHEN regexp_matches({text}, {duck.lit(p)}) THEN {n} ELSE 0 END)" for k, p, n in votes if k == t) for t in order}


def _argmax(score: dict[str, str], least: int, default: str) -> str:
    best = f"greatest({', '.join(score)})"
    return f"CASE WHEN {best} < {least} THEN '{default}' " + " ".join(f"WHEN {t} = {best} THEN '{t}'" for t in score) + " END"


def formats_sql() -> str:
    score = _votes(content.FORMAT_VOTES, content.FORMAT_ORDER, "text")
    columns = ", ".join(f"{v} AS {t}" for t, v in score.items())
    return f"WITH t AS (SELECT 'page' AS kind, page_id AS doc_id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents), v AS (SELECT kind, doc_id, {columns} FROM t) SELECT kind, doc_id, {_argmax(score, 1, 'plaintext')} AS file_type FROM v"


def content_types_sql() -> str:
    score = _votes(content.TYPE_VOTES, content.TYPE_ORDER, "lower(text)")
    columns = ", ".join(f"{v} AS {t}" for t, v in score.items())
    declared = "regexp_extract(lower(text), ':_(?:mod-docs-)?content-type:[ ]*([a-z_]+)', 1)"
    return f"WITH v AS (SELECT doc_id, {declared} AS declared, {columns} FROM documents) SELECT doc_id, CASE WHEN declared <> '' THEN declared ELSE {_argmax(score, 5, 'concept')} END AS content_type FROM v"


PLAINTEXT_SQL = f"""WITH p AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n+') AS p FROM documents),
r AS (SELECT doc_id, unnest(p) AS raw, (generate_subscripts(p, 1) - 1)::INTEGER AS block_idx FROM p),
c AS (SELECT doc_id, block_idx, {duck.strip('raw')} AS content FROM r),
k AS (SELECT doc_id, block_idx, content, CASE WHEN regexp_matches(content, '^[-*•] ') THEN 'list_item_unordered' WHEN regexp_matches(content, '^[0-9]+[.)] ') THEN 'list_item_ordered'
  WHEN regexp_matches(content, '^(?:    |\\t)') THEN 'code' WHEN length(content) <= 80 AND NOT contains(content, chr(10)) AND NOT regexp_matches(content, '[.!?:;,]$') THEN 'heading' ELSE 'paragraph' END AS block_type FROM c)
SELECT doc_id, block_idx, block_type, CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END AS level, content FROM k WHERE content <> ''"""


def queries() -> dict:
    found = {"file_formats": formats, "content_types": content_types, "plaintext_blocks": plaintext_blocks, "semantic_chunks": chunked, "outside_checker": no_matches}
    return found | {f"{k}_blocks": partial(parsed, k) for k in ("markdown", "asciidoc", "xml")}


def oracle_sql() -> dict[str, str]:
    return {"file_formats": formats_sql(), "content_types": content_types_sql(), "plaintext_blocks": PLAINTEXT_SQL}
