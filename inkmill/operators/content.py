"""Content operators: type detection, format detection, chunking, outline numbers, JSON repair, fuzzy matching."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Votes for a content type: (type, pattern on the lower-cased text, points).
TYPE_VOTES = (
    ("procedure", "(?:^|\n)[ ]*(?:[0-9]+[.)]|[.]) ", 20), ("procedure", "prerequisites|procedure|verification", 10), ("procedure", "(?:click|run|install|configure|select) ", 5),
    ("concept", "(?:overview|introduction|about) ", 10), ("concept", "(?: is a | are | refers to | means )", 5),
    ("reference", "[|].*[|]", 20), ("reference", "(?:parameter|option|default|syntax|reference)", 10), ("reference", "[a-z]+[=:][a-z0-9]+", 5),
    ("assembly", "include::", 20), ("release_notes", "(?:release notes|known issues|fixed in|deprecated)", 20),
)
TYPE_ORDER = ("procedure", "concept", "reference", "assembly", "release_notes")


def _voted(votes: tuple, order: tuple[str, ...], text: str) -> dict[str, Column]:
    """Points of each kind, each pattern tested once."""
    return {t: sum((F.when(F.col(text).rlike(p), n).otherwise(0) for k, p, n in votes if k == t), F.lit(0)) for t in order}


def _best(points: dict[str, str], least: int, default: str) -> Column:
    """The kind with the most points, `least` at least; ties by order."""
    best = F.greatest(*[F.col(c) for c in points.values()])
    voted = F.lit(default)
    for t, c in reversed(points.items()):
        voted = F.when((F.col(c) == best) & (best >= least), t).otherwise(voted)
    return voted


def with_content_type(docs: DataFrame, text: str = "text", name: str = "content_type") -> DataFrame:
    """docs with a type: the one with the most points, 5 at least; ties by TYPE_ORDER; a declared attribute wins; else concept.

    Three projections, each over the columns of the one before: the lower-cased text, the points, the choice.
    """
    lowered = docs.select("*", F.lower(text).alias("_lower"))
    declared = F.regexp_extract("_lower", ":_(?:mod-docs-)?content-type:[ ]*([a-z_]+)", 1).alias("_declared")
    scored = lowered.select(*docs.columns, declared, *[c.alias(f"_{t}") for t, c in _voted(TYPE_VOTES, TYPE_ORDER, "_lower").items()])
    voted = _best({t: f"_{t}" for t in TYPE_ORDER}, 5, "concept")
    return scored.select(*docs.columns, F.when(F.col("_declared") != "", F.col("_declared")).otherwise(voted).alias(name))


#: Votes for a file format: (format, pattern on the text, points); an extension gives 3 more.
FORMAT_VOTES = (
    ("asciidoc", "(?m)^={1,6} [^ ]", 3), ("asciidoc", "(?m)^:[a-z_-]+:", 2), ("asciidoc", "(?m)^(?:----|====|[*]{4})$", 2), ("asciidoc", "(?:xref|include|image)::?", 2),
    ("markdown", "(?m)^#{1,6} [^ ]", 3), ("markdown", "(?m)^```", 3), ("markdown", "\\[[^\\]]+\\]\\([^)]+\\)", 2), ("markdown", "(?m)^[-*] [^ ]", 1),
    ("dita", "<!DOCTYPE (?:concept|task|reference|topic|map)", 10), ("dita", "<(?:conbody|taskbody|refbody)", 6),
    ("html", "(?i)<!DOCTYPE html|<html", 8), ("html", "(?i)<(?:div|span|body|p|h[1-6])[ >]", 2),
    ("xml", "^<[?]xml ", 5), ("xml", "<(?:article|section|book|chapter)[ >]", 3),
)
FORMAT_ORDER = ("asciidoc", "markdown", "dita", "html", "xml")
EXTENSIONS = {"adoc": "asciidoc", "asciidoc": "asciidoc", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "xml": "xml", "dita": "dita", "txt": "plaintext", "pdf": "pdf", "docx": "docx"}


def with_file_format(docs: DataFrame, text: str = "text", filename: str | None = None, name: str = "file_type") -> DataFrame:
    """docs with a format: the one with the most votes; without any, plaintext. Binary formats go by their extension."""
    ext = F.lower(F.regexp_extract(F.col(filename), "[.]([A-Za-z]+)$", 1)) if filename else F.lit("")
    by_name = F.lit("")
    for e, f in EXTENSIONS.items():
        by_name = F.when(ext == e, f).otherwise(by_name)
    named = docs.select("*", by_name.alias("_named"))
    votes = {t: c + F.when(F.col("_named") == t, 3).otherwise(0) for t, c in _voted(FORMAT_VOTES, FORMAT_ORDER, text).items()}
    scored = named.select(*docs.columns, "_named", *[c.alias(f"_{t}") for t, c in votes.items()])
    voted = _best({t: f"_{t}" for t in FORMAT_ORDER}, 1, "plaintext")
    return scored.select(*docs.columns, F.when(F.col("_named").isin("pdf", "docx"), F.col("_named")).otherwise(voted).alias(name))


def greedy_chunks(sizes: Column, limit: int) -> Column:
    """Chunk numbers for an array of sizes: a new chunk starts where the running size would pass limit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["used"] > 0) & (acc["used"] + x > limit)
        chunk = acc["chunk"] + F.when(over, 1).otherwise(0)
        return F.struct(F.when(over, x).otherwise(acc["used"] + x).cast("long").alias("used"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def chunks(docs: DataFrame, text: str = "text", limit: int = 3500, overlap: int = 2) -> DataFrame:
    """(doc_id, chunk, first, last, carried, chars): paragraphs packed greedily, the last `overlap` carried into the next chunk."""
    parts = docs.select("doc_id", F.filter(F.split(text, "\n+"), lambda p: F.trim(p) != "").alias("parts"))
    sized = parts.select("doc_id", F.transform("parts", lambda p: F.length(p).cast("long")).alias("sizes"))
    rows = sized.select("doc_id", F.posexplode(F.arrays_zip("sizes", greedy_chunks(F.col("sizes"), limit).alias("chunk"))).alias("part", "x")).select("doc_id", "part", "x.sizes", "x.chunk")
    out = rows.groupBy("doc_id", "chunk").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.sum("sizes").alias("chars"))
    return out.select("doc_id", "chunk", "first", "last", F.when(F.col("chunk") > 0, F.least(F.lit(overlap), F.col("first"))).otherwise(0).alias("carried"), "chars")


def repair(raw: str) -> list[dict]:
    """Objects of a model's raw JSON: fences go, trailing commas go, a cut-off array gives its whole objects."""
    text = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", raw or "")
    for candidate in (text, re.sub(r",\s*([\]}])", r"\1", text)):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
    out, decoder, at = [], json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, end = decoder.raw_decode(re.sub(r",\s*([\]}])", r"\1", text[at:]))
            if isinstance(found, dict):
                out.append(found)
            at = text.find("{", at + end)
        except ValueError:
            at = text.find("{", at + 1)
    return out


def closest(text: str, wanted: str, least: float = 0.85) -> tuple[int, int] | None:
    """The window of wanted's length that is most like it, by SequenceMatcher's ratio."""
    best, size = None, len(wanted)
    for k in range(max(1, len(text) - size + 1)) if wanted else ():
        m = SequenceMatcher(None, text[k : k + size], wanted, autojunk=False)
        if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (r := m.ratio()) >= least and (best is None or r > best[0]):
            best = (r, k)
    return None if best is None else (best[1], best[1] + size)


def fuzzy_spans(pairs: DataFrame) -> DataFrame:
    """(id, start, end) of the closest window, -1 for none; pairs: id, text, wanted."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [closest(t or "", w or "") or (-1, -1) for t, w in zip(pdf.text, pdf.wanted, strict=True)]
            yield pd.DataFrame({"id": pdf.id, "start": [f[0] for f in found], "end": [f[1] for f in found]})

    return pairs.select("id", "text", "wanted").mapInPandas(find, "id long, start int, `end` int")
