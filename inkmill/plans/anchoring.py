"""Queries of outside checkers' offsets, of quotes with edits and of a model's replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors, replies
from ..operators import spanmaps as M
from ..sources import html
from . import duck

#: What the stand-in for a checker finds: it takes line ends for letters, so some finds run over a block's end.
MATCH = "[^ ]{14,}"
#: A sign beyond the first plane takes two UTF-16 units.
SIGNS = ("***", "\U0001f600")


def checker_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds that a checker reports in UTF-16 units of its batches, in the blocks of pages they belong to."""
    b = html.blocks(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("doc_id", "block_idx", F.replace("content", F.lit(SIGNS[0]), F.lit(SIGNS[1])).alias("content"))
    placed = anchors.batches(b, 1500)
    sent = anchors.batch_texts(placed)
    found = M.ranges(sent, MATCH, ("doc_id", "batch")).join(sent, ["doc_id", "batch"])
    units = lambda at: anchors.utf16(F.substring("text", F.lit(1), F.col(at).cast("int")))
    reported = found.select("doc_id", "batch", units("r_start").alias("offset"), (units("r_end") - units("r_start")).alias("length"))
    return anchors.resolve(reported, placed).select("doc_id", "batch", "block_idx", "start", "end", "flagged")


def fuzzy_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document quoted with two edits (a sign lost, a sign changed), and the place where the quote is found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    at = F.floor(F.length("text") / 3).cast("int")
    quote = F.concat(F.substring("text", at + 1, F.lit(7)), F.substring("text", at + 9, F.lit(12)), F.lit("#"), F.substring("text", at + 22, F.lit(20)))
    quotes = docs.where(F.length("text") >= 100).select(F.col("doc_id").alias("quote_id"), "doc_id", quote.alias("quote"))
    return anchors.anchor(quotes, docs).withColumnRenamed("quote_id", "doc_id")


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as a model might report them: fenced, with commas too many, broken off within a list or within an object with a list."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = F.concat(F.lit('{"event": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "note": "a } and, ]", "props": '), F.col("props"), F.lit("}"))
    lists = events.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", one.alias("o")))), lambda x: x["o"]), ", ").alias("l"))
    way = F.pmod("user_id", F.lit(4))
    raw = F.when(way == 0, F.concat(F.lit("["), "l", F.lit("]"))).when(way == 1, F.concat(F.lit("```json\n["), "l", F.lit(",]\n```"))).when(way == 2, F.expr("concat('[', left(l, length(l) - 5))"))
    raw = raw.otherwise(F.expr("""concat('{"reasoning": "a { b", "issues": [', left(l, length(l) - 1))"""))
    found = replies.objects(lists.select("user_id", raw.alias("raw")))
    read = lambda name, kind, default: replies.field(F.col("item"), name, kind, default).alias(name)
    return found.select("user_id", "pos", "whole", read("event", "bigint", -1), read("type", "string", ""), read("severity", "string", "medium"), F.coalesce(F.try_variant_get("item", "$.props.k", "bigint"), F.lit(0)).alias("k"))


_LENGTHS = "list_transform(l, lambda x: length(x.c) + 2)"
SQL = {
    "checker_offsets": f"""WITH {duck.blocks()},
p AS (SELECT doc_id, block_idx, replace(content, '{SIGNS[0]}', '{SIGNS[1]}') AS c FROM html_blocks WHERE trim(content) <> ''),
g AS (SELECT doc_id, list({{'i': block_idx, 'c': c}} ORDER BY block_idx) AS l FROM p GROUP BY doc_id),
f AS (SELECT doc_id, l, list_reduce(list_prepend([0, -1], list_transform({_LENGTHS}, lambda n: [n])), lambda a, x: list_concat(CASE WHEN a[1] > 0 AND a[1] + x[1] > 1500 THEN [x[1], a[2] + 1] ELSE [a[1] + x[1], greatest(a[2], 0)] END, list_concat(a[3:], [CASE WHEN a[1] > 0 AND a[1] + x[1] > 1500 THEN a[2] + 1 ELSE greatest(a[2], 0) END]))) AS s FROM g),
d AS (SELECT doc_id, unnest(l).i AS block_idx, unnest(l).c AS c, unnest(s[3:]) AS batch FROM f),
o AS (SELECT *, (sum(length(c) + 2) OVER (PARTITION BY doc_id, batch ORDER BY block_idx) - length(c) - 2)::BIGINT AS s FROM d),
t AS (SELECT doc_id, batch, string_agg(c, chr(10) || chr(10) ORDER BY block_idx) || chr(10) || chr(10) AS text FROM d GROUP BY ALL),
m AS ({duck.finds('t', 'doc_id, batch', 'text', MATCH)})
SELECT m.doc_id, m.batch::INTEGER AS batch, block_idx, (start_ - s)::INTEGER AS start, (end_ - s)::INTEGER AS "end", hit AS flagged FROM m JOIN o ON o.doc_id = m.doc_id AND o.batch = m.batch AND start_ >= s AND end_ <= s + length(c)""",
    "model_replies": """SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS pos, user_id % 4 < 2 AS whole, event_id AS event, event_type AS type, 'medium' AS severity, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE user_id % 4 < 2 OR back > 1""",
}


def queries() -> dict:
    return {f.__name__: f for f in (checker_offsets, fuzzy_anchors, model_replies)}


def oracle_sql() -> dict[str, str]:
    return SQL
