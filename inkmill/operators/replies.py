"""Raw JSON replies of a model to typed rows, in column expressions.

Code fences and commas before a closing bracket go; what parses is taken as it is (an array, an object, or an object with
an array under a key). From a reply that breaks off, one fold over its characters, which knows strings, escapes and the
depth of brackets, takes the objects that are whole. Fields are read from variants with a default where they are absent or
of another kind.

Null, blank and hopeless replies give no rows; elements that are no objects are left out; strings may hold brackets,
commas and fences of any kind (only a reply's first and last line are fences); repeated keys are refused by the parser, so
that reply gives what its whole objects give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = "struct<depth: int, quoted: boolean, escaped: boolean, start: int, at: int, spans: array<struct<start: int, size: int>>>"


def unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), "(?s)^\\s*```[a-zA-Z]*\\s*|\\s*```\\s*$", "")


def whole_objects(text: Column) -> Column:
    """Array of the outermost complete {...} of a text, as strings."""
    begin = F.from_json(F.lit('{"depth":0,"quoted":false,"escaped":false,"start":0,"at":0,"spans":[]}'), _STATE)

    def step(s: Column, c: Column) -> Column:
        plain = ~s["quoted"]
        opens, closes = plain & (c == "{"), plain & (c == "}") & (s["depth"] > 0)
        ends = closes & (s["depth"] == 1)
        return F.struct(
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when((c == '"') & ~s["escaped"] & (s["depth"] > 0), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["start"]).alias("start"),
            (s["at"] + 1).alias("at"),
            F.when(ends, F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), (s["at"] + 1 - s["start"]).alias("size"))))).otherwise(s["spans"]).alias("spans"),
        ).cast(_STATE)

    spans = F.aggregate(F.split(text, ""), begin, step)["spans"]
    return F.transform(spans, lambda x: F.substring(text, x["start"] + 1, x["size"]))


def without_trailing_commas(text: Column) -> Column:
    """Commas before a closing bracket go; those within strings stay, for strings are matched first and put back."""
    return F.regexp_replace(text, '("(?:[^"\\\\]|\\\\.)*")|,(?=\\s*[\\]}])', "$1")


def objects(replies: DataFrame, raw: str = "raw", key: str = "issues") -> DataFrame:
    """replies' columns with pos, item (a variant object) and whole (whether the reply parsed as it is)."""
    text = replies.withColumn("_text", without_trailing_commas(unfenced(F.col(raw)))).withColumn("_v", F.try_parse_json("_text"))
    listed = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.try_variant_get("_v", f"$.{key}", "array<variant>"), F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.array("_v")))
    # Of an object with a list that breaks off, only what follows the key counts.
    tail = F.when(F.regexp_like("_text", F.lit(f'^\\s*\\{{(?s:.*?)"{key}"\\s*:\\s*\\[')), F.regexp_replace("_text", f'^\\s*\\{{(?s:.*?)"{key}"\\s*:\\s*\\[', "")).otherwise(F.col("_text"))
    saved = F.transform(whole_objects(tail), lambda s: F.try_parse_json(s))
    each = text.select(*replies.columns, F.col("_v").isNotNull().alias("whole"), F.posexplode(F.when(F.col("_v").isNotNull(), listed).otherwise(saved)).alias("pos", "item"))
    return each.where(F.schema_of_variant("item").startswith("OBJECT"))


def field(item: Column, name: str, kind: str, default: object) -> Column:
    """A field of a variant object, or the default where it is absent, null or of another kind."""
    return F.coalesce(F.try_variant_get(item, f"$.{name}", kind), F.lit(default).cast(kind))
