"""PDF files that Spark makes of the documents, read back by their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import layout


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of every document: its lines are paragraphs, a short first line is its title, other short lines are headings, some of them not bold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    said = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, "[ \\t\\r\\n]+", " ")))

    def styled(s, i):
        words, title = F.size(F.split(s, " ")), i == 0
        title = title & (words <= layout.LINE_WORDS)
        size = F.when(title, 24.0).when(words <= 5, 16.0).otherwise(11.0)
        return F.struct(s.alias("text"), size.alias("size"), (title | (words <= 5) & (F.length(s) % 2 == 1)).alias("bold"))

    paragraphs = F.transform(F.filter(said, lambda s: s != ""), styled)
    return layout.render(docs.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("head"), paragraphs.alias("paragraphs")))


def pdf_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the files, by layout alone."""
    return layout.blocks(layout.runs(pdf_files(spark, sf_dir)))


def pdf_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files that go, by reason, for each document."""
    return layout.lines(layout.runs(pdf_files(spark, sf_dir))).where("dropped IS NOT NULL").groupBy("doc_id", "dropped").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


#: The lines as they lie on the pages, counted from the texts: 24 a page, 12 words each.
_LINES = """p0 AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(regexp_replace(s, '[ \\t\\r\\n]+', ' ', 'g'))), lambda s: s <> '') AS l FROM documents),
p1 AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM p0),
p2 AS (SELECT *, string_split(s, ' ') AS w, i = 0 AND len(string_split(s, ' ')) <= 12 AS title FROM p1),
p3 AS (SELECT doc_id, i, w, CASE WHEN title THEN 24 WHEN len(w) <= 5 THEN 16 ELSE 11 END AS size, title OR (len(w) <= 5 AND length(s) % 2 = 1) AS bold, unnest(range((len(w) + 11) // 12)) AS j FROM p2),
p4 AS (SELECT doc_id, array_to_string(w[j * 12 + 1:j * 12 + 12], ' ') AS text, size, bold, CASE WHEN j = 0 THEN 90 ELSE 72 END AS x, CASE WHEN j > 0 THEN 12 WHEN size < 24 THEN 24 ELSE 36 END AS step,
  row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM p3),
p5 AS (SELECT doc_id, text, size, bold, x, n, (n - 1) // 24 + 1 AS page, 670 - sum(step) OVER (PARTITION BY doc_id, (n - 1) // 24 ORDER BY n) AS y FROM p4),
sheets AS (SELECT DISTINCT doc_id, page FROM p5),
drawn AS (SELECT * FROM p5 UNION ALL SELECT doc_id, 'Document ' || doc_id, 9, false, 72, 0, page, 690 FROM sheets
  UNION ALL SELECT doc_id, 'CONFIDENTIAL', 80, false, 60, -1, page, 380 FROM sheets UNION ALL SELECT doc_id, 'Page ' || page, 9, false, 72, -2, page, 30 FROM sheets),
often AS (SELECT doc_id, text, y FROM drawn GROUP BY ALL HAVING count(DISTINCT page) >= 3),
judged AS (SELECT d.*, CASE WHEN d.y = 30 THEN 'margin' WHEN o.y IS NOT NULL THEN 'repeated' WHEN d.size = 80 THEN 'watermark' END AS dropped FROM drawn d LEFT JOIN often o ON o.doc_id = d.doc_id AND o.text = d.text AND o.y = d.y)"""
SQL = {
    "pdf_layout": f"""WITH {_LINES},
sizes AS (SELECT doc_id, size, sum(length(replace(text, ' ', ''))) AS signs FROM judged WHERE dropped IS NULL GROUP BY ALL),
body AS (SELECT doc_id, first(size ORDER BY signs DESC, size) AS body FROM sizes GROUP BY doc_id),
k AS (SELECT *, lag(size) OVER o AS size0, lag(bold) OVER o AS bold0, lag(page) OVER o AS page0, lag(y) OVER o AS y0 FROM judged WHERE dropped IS NULL WINDOW o AS (PARTITION BY doc_id ORDER BY page, n)),
c AS (SELECT *, sum(CASE WHEN page0 IS NULL OR size <> size0 OR bold <> bold0 OR x = 90 OR (page = page0 AND y0 - y > 1.4 * size) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, n) - 1 AS block_idx FROM k),
b AS (SELECT doc_id, block_idx, min(page) AS page, any_value(size) AS size, any_value(bold) AS bold, string_agg(text, ' ' ORDER BY page, n) AS content FROM c GROUP BY ALL)
SELECT doc_id, block_idx::INTEGER AS block_idx, page::INTEGER AS page, CASE WHEN bold OR size >= 1.3 * body THEN 'heading' ELSE 'paragraph' END AS block_type,
CASE WHEN NOT (bold OR size >= 1.3 * body) THEN 0 WHEN size >= 24 THEN 1 WHEN size >= 16 THEN 3 ELSE 6 END AS level, content FROM b JOIN body USING (doc_id)""",
    "pdf_furniture": f"WITH {_LINES} SELECT doc_id, dropped, count(*) AS n, count(DISTINCT text) AS texts FROM judged WHERE dropped IS NOT NULL GROUP BY ALL",
}


def queries() -> dict:
    return {"pdf_layout": pdf_layout, "pdf_furniture": pdf_furniture}


def oracle_sql() -> dict[str, str]:
    return SQL
