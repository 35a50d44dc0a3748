"""HTML to blocks in column expressions: a page is cut at block tags, each piece takes its type from the tag before it.

Head, scripts, styles, vector graphics and comments go first. Inline tags and entities are undone in the text. A list
item is ordered or not by the last list opened before it. Pages without block tags are one paragraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKIPPED = ("head", "script", "style", "noscript", "svg", "math")
TAGS = "(?i)<(/?(?:h[1-6]|p|li|ol|ul|dt|dd|pre|blockquote|td|th|div|article|section|nav|table|tr|main|body|header|footer))(?:[ \\t\\r\\n][^>]*)?/?>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, block_idx, block_type, level, content) of pages, in order, without empty blocks."""
    t = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), "(?s)<!--.*?-->", "")
    for tag in SKIPPED:
        t = F.regexp_replace(t, f"(?is)<{tag}[ >].*?</{tag}>", "")
    cut = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(t, TAGS, "\x01$1\x02"), "\x01")).alias("block_idx", "piece"))
    tag = F.lower(F.when(F.col("piece").contains("\x02"), F.split("piece", "\x02")[0]).otherwise(""))
    body = F.when(F.col("piece").contains("\x02"), F.try_element_at(F.split("piece", "\x02"), F.lit(2))).otherwise(F.col("piece"))
    text = F.regexp_replace(body, "<[^>]*>", " ")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\n]+", " "), "^ | $", "")
    tagged = cut.select("doc_id", "block_idx", tag.alias("tag"), text.alias("content"))
    opened = F.last(F.when(F.col("tag").isin("ol", "ul"), F.col("tag")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("block_idx"))
    kind = (
        F.when(F.col("tag").rlike("^h[1-6]$"), "heading")
        .when((F.col("tag") == "li") & (F.col("opened") == "ol"), "list_item_ordered")
        .when(F.col("tag") == "li", "list_item_unordered")
        .when(F.col("tag").isin("dt", "dd"), "dlist")
        .when(F.col("tag") == "pre", "listing")
        .when(F.col("tag") == "blockquote", "blockquote")
        .when(F.col("tag").isin("td", "th"), "table_cell")
        .otherwise("paragraph")
    )
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")).otherwise(0)
    return tagged.withColumn("opened", opened).select("doc_id", "block_idx", kind.alias("block_type"), level.alias("level"), "content").where("content <> ''")
