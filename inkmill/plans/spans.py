"""Queries of offset maps and range guards: issues of cleaned text, with their places in the source.

Sources with markup: the pages' HTML, and an AsciiDoc text that both engines make from the pages' blocks. The SQL follows
every character through the steps by lists of places; Spark composes runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import revisions as V
from ..operators import spanmaps as M
from ..sources import html
from . import duck

#: Signs in threes, and very long words.
FLAGGED = "[%&$#]{3,}|\\p{L}{14,}"

SKIP = "|".join(f"<{t}[ >].*?</{t}>" for t in html.SKIPPED)
TAG = html.TAGS.removeprefix("(?i)").replace("(/?(?:", "/?(?:", 1).replace(")(?:[ \\t", ")(?:[ \\t", 1).replace("main|body|header|footer))", "main|body|header|footer)")
MARKUP = f"(?is)<!--.*?-->|{SKIP}|{TAG}|<[^>]*>|&(?:lt|gt|quot|#39|nbsp|amp);"


def _block_tag(hit):
    """What stands for a piece of markup: nothing, a border between blocks, a blank, or the sign of an entity."""
    sign = F.when(hit == "&amp;", "&")
    for entity, text in html.ENTITIES:
        sign = sign.when(hit == entity, text)
    return F.when(hit.startswith("&"), sign).when(F.regexp_like(hit, F.lit(f"(?is)^(?:<!--.*|{SKIP})$")), "").when(F.regexp_like(hit, F.lit(f"(?i)^{TAG}$")), "\x01").otherwise(" ")


HTML_STEPS = [M.Step(f"({MARKUP})()()", _block_tag), M.fixed("[ \\t\\r\\n]+", " "), M.fixed(" ?\\x01 ?", "\x01")]
#: The same steps, where finds that stand for themselves (a single blank, a border without blanks) are left in their gaps.
HTML_CHANGES = [HTML_STEPS[0], M.fixed("(?: [ \\t\\r\\n]|[\\t\\r\\n])[ \\t\\r\\n]*", " "), M.fixed(" \\x01 ?|\\x01 ", "\x01")]
ASCIIDOC_STEPS = [
    M.delete("(?m)^(?:={1,6}|\\*{1,5}|\\.{1,5}) "),
    M.keep("\\*", "[^*\\n]+", "\\*"),
    M.keep("link:[^\\s\\[\\]]*\\[", "[^\\]\\n]*", "\\]"),
    M.fixed("`[^`\\n]+`", "placeholder"),
    M.fixed("\\n{3,}", "\n\n"),
    M.fixed(" {2,}", " "),
]
CODE = "`[^`\\n]+`"


def _finds(texts: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """(keys, start, end, flagged) of FLAGGED in texts."""
    found = M.ranges(texts.withColumn("text", F.col(text)), FLAGGED, keys)
    back = found.join(texts.select(*keys, F.col(text).alias("whole")), list(keys))
    return back.select(*keys, F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.substring("whole", F.col("r_start").cast("int") + 1, (F.col("r_end") - F.col("r_start")).cast("int")).alias("flagged"))


def html_issue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds in the blocks of pages, with their places in the block and in the page's HTML."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")).repartition("doc_id")
    # Borders are followed with the finds: the last one before a find begins its block.
    found = M.traced(pages, HTML_CHANGES, f"\x01|{FLAGGED}", ("doc_id",))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    border = F.col("flagged") == "\x01"
    placed = found.withColumns({"block_idx": F.count_if(border).over(before).cast("int"), "offset": F.coalesce(F.max(F.when(border, F.col("end"))).over(before), F.lit(0))}).where(~border)
    cut = F.substring("text", F.col("raw_start").cast("int") + 1, (F.col("raw_end") - F.col("raw_start")).cast("int"))
    return placed.join(pages, "doc_id").select("doc_id", "block_idx", (F.col("start") - F.col("offset")).alias("start"), "flagged", "raw_start", "raw_end", cut.alias("raw_text"))


_LINK, _CODE, _BOLD = ("(^| )(of) ", "$1link:/$2[$2] "), ("(^| )((?:th|on)[a-z]+)", "$1`$2`"), ("(^| )([A-Z][a-z]+)", "$1*$2*")


def asciidoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): AsciiDoc made of the pages' blocks; some words become links, code or bold."""
    b = html.blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    body = F.col("content")
    for pattern, put in (_LINK, _CODE, _BOLD):
        body = F.regexp_replace(body, pattern, put)
    head = F.when(F.col("block_type") == "heading", F.concat(F.repeat(F.lit("="), F.col("level")), F.lit(" "))).when(F.col("block_type").startswith("list_item"), F.lit("* ")).otherwise("")
    lines = b.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", F.concat(head, body, F.lit("\n")).alias("line")))).alias("l"))
    return lines.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def asciidoc_issue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds in cleaned AsciiDoc, with their places in the source, by the map and, as a check on it, by looking near by."""
    docs = asciidoc(spark, sf_dir)
    placed = M.traced(docs, ASCIIDOC_STEPS, FLAGGED, ("doc_id",)).join(docs, "doc_id")
    again = M.refind(F.col("text"), F.col("flagged"), F.col("raw_start"))
    return placed.select("doc_id", "start", "flagged", "raw_start", "raw_end", again["start"].alias("found_start"))


def guarded_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of eight letters or more in AsciiDoc without markers, less those that begin in inline code; code is found in the source."""
    docs = asciidoc(spark, sf_dir)
    steps = [*ASCIIDOC_STEPS[:3], M.keep("`", "[^`\\n]+", "`")]
    words = M.traced(docs, steps, "\\p{L}{8,}", ("doc_id",), guard=CODE)
    return words.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("start").alias("sum_start"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages' blocks, and the same edited: some gone, some changed, some twice, each third moved back by four places."""
    old = html.blocks(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("doc_id", "block_idx", "block_type", "content")
    way = F.pmod(F.col("doc_id") + 7 * F.col("block_idx"), F.lit(12))
    place = F.col("block_idx") * 10 - F.when(way % 3 == 2, 40).otherwise(0)
    body = F.when(way == 4, F.concat("content", F.lit(" &&&& again"))).otherwise(F.col("content"))
    copies = F.sequence(F.lit(1), F.when(way == 5, 2).otherwise(1))
    edited = old.where(way != 0).select("doc_id", place.alias("place"), "block_idx", "block_type", body.alias("content"), F.explode(copies).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "block_idx", "copy")) - 1
    return old, edited.select("doc_id", rank.alias("block_idx"), "block_type", "content")


def _block_finds(blocks: DataFrame) -> DataFrame:
    found = _finds(blocks, ("doc_id", "block_idx"), "content").join(blocks.select("doc_id", "block_idx", "offset"), ["doc_id", "block_idx"])
    return found.select("doc_id", "block_idx", (F.col("offset") + F.col("start")).alias("start"), (F.col("offset") + F.col("end")).alias("end"), "flagged")


def incremental_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finds of an edited version of the pages; those of unchanged blocks are carried over from the version before."""
    old, new = (V.snapshot(v) for v in _versions(spark, sf_dir))
    return V.rerun(old, new, _block_finds(old), _block_finds)


def moved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' blocks that an edited version still has: how many, and how many have changed their order."""
    old, new = (V.snapshot(v) for v in _versions(spark, sf_dir))
    return V.aligned(V.matched(old, new)).groupBy("doc_id").agg(F.count("*").alias("n_same"), F.count_if("moved").alias("n_moved"), F.sum("shift").alias("sum_shift"))


# -- the same by characters


def _step(n: int, source: str, pattern: str, put: str) -> str:
    """CTEs t{n}(doc_id, text, a, z) of a step over t{n - 1}: a and z hold each character's first place in the source and the one after its last.

    put: SQL for what stands for hit h; `kept` in it begins where the pattern's kept group does.
    """
    p = duck.lit(pattern)
    kept = put.startswith("kept:")
    text = f"regexp_extract(h, {p}, 2)" if kept else put
    first = f"p + length(regexp_extract(h, {p}, 1))" if kept else "p"
    take = f"list_concat({{x}}[s + 1:p], {{x}}[{first} + 1:{first} + length(w)])" if kept else "list_concat({x}[s + 1:p], list_transform(range(length(w)), lambda k: {one}))"
    return f"""c{n} AS (SELECT doc_id, text, a, z, string_split_regex(text, {p}) AS g, list_append(regexp_extract_all(text, {p}), NULL) AS hits FROM {source}),
d{n} AS (SELECT doc_id, a, z, i, gap, h, (s - length(gap))::BIGINT AS s, s AS p, CASE WHEN h IS NULL THEN '' ELSE {text} END AS w, text AS whole FROM (
  SELECT *, (sum(length(gap) + coalesce(length(h), 0)) OVER (PARTITION BY doc_id ORDER BY i) - coalesce(length(h), 0))::BIGINT AS s FROM (SELECT doc_id, text, a, z, unnest(g) AS gap, unnest(hits) AS h, generate_subscripts(g, 1) AS i FROM c{n}))),
t{n} AS (SELECT doc_id, string_agg(gap || w, '' ORDER BY i) AS text, flatten(list({take.format(x='a', one='a[p + 1]')} ORDER BY i)) AS a, flatten(list({take.format(x='z', one='z[p + length(h)]')} ORDER BY i)) AS z FROM d{n} GROUP BY doc_id)"""


_SIGN = "CASE h " + " ".join(f"WHEN {duck.lit(e)} THEN {duck.lit(s)}" for e, s in html.ENTITIES) + " END"
_PUT = f"CASE WHEN h LIKE '&%' THEN {_SIGN} WHEN regexp_matches(h, {duck.lit(f'(?is)^(?:<!--.*|{SKIP})$')}) THEN '' WHEN regexp_matches(h, {duck.lit(f'(?i)^{TAG}$')}) THEN chr(1) ELSE ' ' END"
_START = "t0 AS (SELECT {key} AS doc_id, coalesce({text}, '') AS text, range(length(coalesce({text}, ''))) AS a, range(1, length(coalesce({text}, '')) + 1) AS z FROM {table})"


def _duck_put(put: str) -> str:
    return put.replace("$1", "\\1").replace("$2", "\\2")


def _asciidoc_sql() -> str:
    body = "content"
    for pattern, put in (_LINK, _CODE, _BOLD):
        body = f"regexp_replace({body}, {duck.lit(pattern)}, {duck.lit(_duck_put(put))}, 'g')"
    head = "CASE WHEN block_type = 'heading' THEN repeat('=', level) || ' ' WHEN starts_with(block_type, 'list_item') THEN '* ' ELSE '' END"
    return f"{duck.blocks()},\nadoc AS (SELECT doc_id, string_agg({head} || {body} || chr(10), chr(10) ORDER BY block_idx) AS text FROM html_blocks GROUP BY doc_id)"


def _steps_sql(steps: list[M.Step], puts: list[str]) -> str:
    return ",\n".join(_step(k, f"t{k - 1}", s.pattern, put) for k, (s, put) in enumerate(zip(steps, puts, strict=True), 1))


_HTML_SQL = f"""WITH {_START.format(key='page_id', text='html', table='pages')},
{_steps_sql(HTML_STEPS, [_PUT, "' '", "chr(1)"])},
b AS (SELECT doc_id, a, z, unnest(string_split(text, chr(1))) AS content, generate_subscripts(string_split(text, chr(1)), 1) - 1 AS block_idx FROM t3),
o AS (SELECT *, (sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY block_idx) - length(content) - 1)::BIGINT AS off FROM b),
f AS ({duck.finds('o', 'doc_id, block_idx, off, a, z', 'content', FLAGGED)})
SELECT doc_id, block_idx::INTEGER AS block_idx, start_::BIGINT AS start, hit AS flagged, a[off + start_ + 1]::BIGINT AS raw_start, z[off + end_]::BIGINT AS raw_end, substr(html, (a[off + start_ + 1] + 1)::BIGINT, (z[off + end_] - a[off + start_ + 1])::BIGINT) AS raw_text
FROM f JOIN pages ON page_id = doc_id"""

_NEAR = "(SELECT list_min(list_transform(list_filter(range(greatest(0, r - 3 * length(hit) - 200), least(length(whole), r + 3 * length(hit) + 200)), lambda k: substr(whole, k + 1, length(hit)) = hit), lambda k: abs(k - r) * 1000000 + k)) % 1000000)"
_ASCIIDOC_SPANS = f"""WITH {_asciidoc_sql()},
{_START.format(key='doc_id', text='text', table='adoc')},
{_steps_sql(ASCIIDOC_STEPS, ["''", "kept:", "kept:", "'placeholder'", "chr(10) || chr(10)", "' '"])},
f AS (SELECT doc_id, hit, start_, a[start_ + 1] AS r, z[end_] AS e, whole FROM ({duck.finds('t6', 'doc_id, a, z', 'text', FLAGGED)}) JOIN (SELECT doc_id, text AS whole FROM adoc) USING (doc_id))
SELECT doc_id, start_::BIGINT AS start, hit AS flagged, r::BIGINT AS raw_start, e::BIGINT AS raw_end, coalesce({_NEAR}, -1)::BIGINT AS found_start FROM f"""

_GUARDED = f"""WITH {_asciidoc_sql()},
{_START.format(key='doc_id', text='text', table='adoc')},
{_steps_sql([*ASCIIDOC_STEPS[:3], M.keep("`", "[^`\\n]+", "`")], ["''", "kept:", "kept:", "kept:"])},
code AS (SELECT doc_id, start_ AS r_start, end_ AS r_end FROM ({duck.finds('adoc', 'doc_id', 'text', CODE)})),
w AS (SELECT doc_id, start_ AS s, a[start_ + 1] AS r FROM ({duck.finds('t4', 'doc_id, a', 'text', '\\p{L}{8,}')}))
SELECT doc_id, count(*) AS kept, sum(s)::BIGINT AS sum_start FROM w WHERE NOT EXISTS (SELECT 1 FROM code c WHERE c.doc_id = w.doc_id AND c.r_start <= r AND r < c.r_end) GROUP BY doc_id"""


#: A full run over the edited version; a find is carried if its block's hash is as often in the old version as up to here.
_VERSIONS = f"""{duck.blocks()},
ways AS (SELECT *, (doc_id + 7 * block_idx) % 12 AS way FROM html_blocks),
edited AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx * 10 - CASE WHEN way % 3 = 2 THEN 40 ELSE 0 END, block_idx, copy) - 1 AS block_idx, block_type, CASE WHEN way = 4 THEN content || ' &&&& again' ELSE content END AS content
  FROM (SELECT *, unnest(range(CASE WHEN way = 5 THEN 2 ELSE 1 END)) AS copy FROM ways WHERE way <> 0)),
olds AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_type, content ORDER BY block_idx) AS k, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY block_idx) - length(content) - 1 AS off FROM html_blocks),
news AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_type, content ORDER BY block_idx) AS k, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY block_idx) - length(content) - 1 AS off FROM edited),
both_ AS (SELECT n.doc_id, n.block_idx, n.content, n.off::BIGINT AS off, o.block_idx AS old_idx, o.off::BIGINT AS was FROM news n LEFT JOIN olds o USING (doc_id, block_type, content, k))"""
_INCREMENTAL = f"""WITH {_VERSIONS},
f AS ({duck.finds('both_', 'doc_id, block_idx, off, old_idx', 'content', FLAGGED)})
SELECT doc_id, block_idx::INTEGER AS block_idx, off + start_ AS start, off + end_ AS "end", hit AS flagged, old_idx IS NOT NULL AS carried FROM f"""


def queries() -> dict:
    return {f.__name__: f for f in (incremental_issues, moved_blocks, html_issue_spans, asciidoc_issue_spans, guarded_issues)}


def oracle_sql() -> dict[str, str]:
    return {"incremental_issues": _INCREMENTAL, "html_issue_spans": _HTML_SQL, "asciidoc_issue_spans": _ASCIIDOC_SPANS, "guarded_issues": _GUARDED}
