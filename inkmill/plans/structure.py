"""Queries of the tier merge, of nested blocks and of the module graph, with SQL that folds and recurses instead."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import forest, modules, tiers
from ..operators import spanmaps as M
from . import duck

#: What the finders look for in a document: (finder, pattern, category). The order is that of their issues in a document.
FINDERS = (
    ("rules", "[%&$#]{3,}", "punctuation"),
    ("rules", "\\p{L}{16,}", "word-usage"),
    ("checker", "\\p{L}+[%&$#]{2}", "punctuation"),
    ("checker", "\\p{L}{14,}", "grammar"),
    ("granular", "\\p{L}+ \\p{L}{13,}", "style"),
    ("granular", "\\p{L}{13,}", "style"),
    ("global", "\\p{L}{13,}[^\\p{L}]*", "style"),
    ("global", "\\p{L}+ \\p{L}{12,} \\p{L}+", "audience"),
)


def _at_words(pattern: str) -> str:
    """A pattern of the same finds that takes runs of letters whole and begins at none but their first one, as all finds do.

    Otherwise the search begins anew at each letter of a word, and gives letters back one by one.
    """
    whole = re.sub(r"(\\p\{L\}(?:\+|\{\d+,\}))", r"\1+", pattern)
    return f"(?<!\\p{{L}}){whole}" if pattern.startswith("\\p{L}") else whole


def finder_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, source, category, flagged, start, end, confidence) of FINDERS over documents; ord runs by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sources, categories = (F.array(*[F.lit(f[c]) for f in FINDERS]) for c in (0, 2))
    found = M.finds_of(docs, [_at_words(pattern) for _, pattern, _ in FINDERS], ("doc_id",)).withColumnRenamed("level", "finder")
    confidence = (0.5 + (F.col("end") - F.col("start")) % 6 / 10).alias("confidence")
    told = found.select("doc_id", "finder", sources[F.col("finder")].alias("source"), categories[F.col("finder")].alias("category"), "flagged", "start", "end", confidence)
    tier = F.when(F.col("source").isin("granular", "global"), "model").otherwise(F.col("source"))
    order = Window.partitionBy("doc_id", tier).orderBy("start", "finder")
    return told.withColumn("ord", F.row_number().over(order)).drop("finder")


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..operators.rounds import cut

    issues = cut(finder_issues(spark, sf_dir))
    return tuple(issues.where(F.col("source").isin(*s)) for s in (("rules",), ("checker",), ("granular", "global")))


def model_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of two passes of a stand-in model without what repeats an earlier one."""
    return tiers.dedup_model(_tiers(spark, sf_dir)[2]).select("doc_id", "ord", "source", "flagged", "start", "end")


def tier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of rules, of a stand-in checker and of a stand-in model, merged."""
    return tiers.merge_tiers(*_tiers(spark, sf_dir)).select("doc_id", "tier", "ord", "source", "category", "flagged", "start", "end")


def _outline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: a line of up to four words is a heading of as many levels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_idx", "content"))
    words = F.size(F.split(F.trim("content"), " +"))
    heading = (F.trim("content") != "") & (words <= 4)
    return lines.select("doc_id", "block_idx", F.when(heading, "heading").otherwise("paragraph").alias("block_type"), F.when(heading, words).otherwise(0).alias("level"))


def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line under its heading: parent, depth, counter, nested-set numbers."""
    return forest.numbered(forest.parents_by_level(_outline_blocks(spark, sf_dir))).select("doc_id", "block_idx", "parent_idx", "depth", "number", "size", "lft", "rgt", "place")


def module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first word of their title, joined by their links: component, its size and its layer."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = F.lower(F.regexp_extract("html", "<h1>([A-Za-z]+)", 1))
    edges = pages.select(title.alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)[^"]*"'), F.lit(1))).alias("target")).where("source <> ''").select("source", F.lower("target").alias("target"))
    # Most links lead to words that are no title: pages of one first letter stand for each other as well, which makes cycles.
    letters = edges.select(F.left("source", F.lit(2)).alias("source"), F.left("target", F.lit(2)).alias("target"))
    edges = modules.cut(edges.unionByName(letters).distinct())
    found = modules.cut(modules.components(edges))
    return found.join(modules.layers(edges, found), "component").select("node", "component", "size", "layer")


# -- SQL

_NORM = "lower(trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g')))"
_EACH = "\nUNION ALL\n".join(f"SELECT doc_id, {k} AS finder, '{s}' AS source, '{c}' AS category, hit AS flagged, start_::BIGINT AS s, end_::BIGINT AS e FROM ({duck.finds('documents', 'doc_id', 'text', p)})" for k, (s, p, c) in enumerate(FINDERS))
_BROAD = "CASE category " + " ".join(f"WHEN {duck.lit(a)} THEN {duck.lit(b)}" for a, b in tiers.GROUPS.items()) + " ELSE 'other' END"
_LAP = "(least(x.e, y.e) - greatest(x.s, y.s))"
_SHORT = "least(x.e - x.s, y.e - y.s)"
_ISSUES = f"""every AS ({_EACH}),
issues AS (SELECT *, {_NORM.format(c='flagged')} AS t, {_BROAD} AS grp, 0.5 + (e - s) % 6 / 10 AS confidence, CASE source WHEN 'rules' THEN 1 WHEN 'checker' THEN 2 ELSE 3 END AS tier,
  row_number() OVER (PARTITION BY doc_id, CASE source WHEN 'rules' THEN 1 WHEN 'checker' THEN 2 ELSE 3 END ORDER BY s, finder)::INTEGER AS ord FROM every),
lists AS (SELECT doc_id, list([{{'ord': ord, 'source': source, 'category': category, 'flagged': flagged, 't': t, 's': s, 'e': e, 'tier': tier, 'grp': grp, 'confidence': confidence}}] ORDER BY ord) AS l FROM issues WHERE tier = 3 GROUP BY doc_id),
deduped AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, y_: CASE WHEN len(list_filter(acc, lambda x: x.t = y_[1].t OR (x.source = y_[1].source AND (contains(' ' || x.t || ' ', ' ' || y_[1].t || ' ') OR contains(' ' || y_[1].t || ' ', ' ' || x.t || ' '))) OR {(_LAP + ' > 0.8 * ' + _SHORT).replace('y.', 'y_[1].')})) > 0 THEN acc ELSE list_concat(acc, y_) END)) AS i FROM lists)"""
_DEDUP = f"WITH {_ISSUES}\nSELECT doc_id, i.ord AS ord, i.source AS source, i.flagged AS flagged, i.s AS start, i.e AS \"end\" FROM deduped"
_MERGE = f"""WITH {_ISSUES},
pool AS (SELECT doc_id, {{'ord': ord, 'source': source, 'category': category, 'flagged': flagged, 't': t, 's': s, 'e': e, 'tier': tier, 'grp': grp, 'confidence': confidence}} AS i FROM issues WHERE tier < 3 UNION ALL SELECT doc_id, i FROM deduped WHERE i.confidence >= 0.7),
folded AS (SELECT doc_id, unnest(list_reduce(list([i] ORDER BY i.tier, i.ord), lambda acc, y_: CASE WHEN y_[1].tier > 1 AND len(list_filter(acc, lambda x: x.grp = y_[1].grp AND (x.t = y_[1].t OR {(_LAP + ' > 0.5 * ' + _SHORT).replace('y.', 'y_[1].')}))) > 0 THEN acc ELSE list_concat(acc, y_) END)) AS i FROM pool GROUP BY doc_id)
SELECT doc_id, i.tier AS tier, i.ord AS ord, i.source AS source, i.category AS category, i.flagged AS flagged, i.s AS start, i.e AS "end" FROM folded"""

_OUTLINE = """WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx FROM documents),
b AS (SELECT doc_id, idx, CASE WHEN trim(content) <> '' AND len(string_split_regex(trim(content), ' +')) <= 4 THEN len(string_split_regex(trim(content), ' +')) ELSE 0 END AS level FROM lines),
up AS (SELECT x.doc_id, x.idx, max(y.idx) AS parent FROM b x LEFT JOIN b y ON y.doc_id = x.doc_id AND y.idx < x.idx AND y.level > 0 AND (x.level = 0 OR y.level < x.level) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY idx) AS r FROM up),
down AS (SELECT doc_id, idx, parent, 0 AS depth, CAST(r AS VARCHAR) AS number, [idx] AS line FROM ranked WHERE parent IS NULL UNION ALL SELECT c.doc_id, c.idx, c.parent, d.depth + 1, d.number || '.' || c.r, list_append(d.line, c.idx) FROM ranked c JOIN down d ON c.doc_id = d.doc_id AND c.parent = d.idx),
sizes AS (SELECT doc_id, above AS idx, count(*) AS size FROM (SELECT doc_id, unnest(line) AS above FROM down) GROUP BY ALL)
SELECT doc_id, idx::INTEGER AS block_idx, parent::INTEGER AS parent_idx, depth::INTEGER AS depth, number, size, 2 * place - 1 - depth AS lft, 2 * place - 2 - depth + 2 * size AS rgt, place
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS place FROM down JOIN sizes USING (doc_id, idx))"""

_MODULES = """WITH RECURSIVE links AS (SELECT lower(regexp_extract(html, '<h1>([A-Za-z]+)', 1)) AS s, lower(unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)[^"]*"', 1))) AS t FROM pages),
edges AS (SELECT s, t FROM links WHERE s <> '' UNION SELECT left(s, 2), left(t, 2) FROM links WHERE s <> ''),
nodes AS (SELECT s AS node FROM edges UNION SELECT t FROM edges),
reach AS (SELECT s, t FROM edges UNION SELECT r.s, e.t FROM reach r JOIN edges e ON e.s = r.t),
comps AS (SELECT node, least(node, min(b.t)) AS component FROM nodes LEFT JOIN (SELECT a.s, a.t FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s) b ON b.s = node GROUP BY node),
dag AS (SELECT DISTINCT a.component AS s, b.component AS t FROM edges JOIN comps a ON a.node = s JOIN comps b ON b.node = t WHERE a.component <> b.component),
ways AS (SELECT DISTINCT component AS c, 0 AS n FROM comps UNION SELECT t, n + 1 FROM ways JOIN dag ON dag.s = ways.c)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size, layer::INTEGER AS layer FROM comps JOIN (SELECT c, max(n) AS layer FROM ways GROUP BY c) ON c = component"""


def queries() -> dict:
    return {f.__name__: f for f in (model_dedup, tier_merge, outline_tree, module_graph)}


def oracle_sql() -> dict[str, str]:
    return {"model_dedup": _DEDUP, "tier_merge": _MERGE, "outline_tree": _OUTLINE, "module_graph": _MODULES}
