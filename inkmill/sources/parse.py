"""Parsers for nested formats: text or bytes to block rows, run in Arrow batches by `blocks`.

Each parser is a function text -> list of (block_type, level, content, parent). Blocks come in document order; parent
is the index of the enclosing block or -1. Plain text and HTML have native versions (`plaintext`, `html.blocks`).
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Block = tuple[str, int, str, int]
SCHEMA = "doc_id long, block_idx int, parent_idx int, block_type string, level int, content string"

INLINE = (re.compile(r"`([^`]*)`"), re.compile(r"\*\*?([^*]+)\*\*?"), re.compile(r"\b__?([^_]+)__?\b"), re.compile(r"(?:xref|link|https?):[^\s\[]*\[([^\]]*)\]"), re.compile(r"!?\[([^\]]*)\]\([^)]*\)"))


def strip_inline(text: str) -> str:
    """Text without inline markup."""
    for p in INLINE:
        text = p.sub(r"\1", text)
    return text


def strip_with_map(text: str) -> tuple[str, list[int]]:
    """Stripped text and, for each of its characters, its place in the original."""
    keep = list(range(len(text)))
    for p in INLINE:
        now = "".join(text[k] for k in keep)
        drop: set[int] = set()
        for m in p.finditer(now):
            a, b = m.span(1)
            drop |= set(range(m.start(), a)) | set(range(b, m.end()))
        keep = [k for j, k in enumerate(keep) if j not in drop]
    return "".join(text[k] for k in keep), keep


def markdown(text: str) -> list[Block]:
    out: list[Block] = []
    fence, body = "", []

    def close() -> None:
        if body:
            out.append(("paragraph", 0, " ".join(body), -1))
            body.clear()

    for line in text.splitlines():
        mark = re.match(r"^\s*(```+|~~~+)", line)
        if fence:
            if mark and mark[1].startswith(fence):
                out.append(("code", 0, "\n".join(body), -1))
                body.clear()
                fence = ""
            else:
                body.append(line)
        elif mark:
            close()
            fence = mark[1]
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            out.append(("heading", len(m[1]), m[2], -1))
        elif m := re.match(r"^\s*[-*+]\s+(.*)", line):
            close()
            out.append(("list_item_unordered", 0, m[1], -1))
        elif m := re.match(r"^\s*\d+[.)]\s+(.*)", line):
            close()
            out.append(("list_item_ordered", 0, m[1], -1))
        elif m := re.match(r"^>\s?(.*)", line):
            close()
            out.append(("blockquote", 0, m[1], -1))
        elif re.match(r"^\s*\|.*\|\s*$", line):
            close()
            if not re.fullmatch(r"[\s|:-]+", line):
                out += [("table_cell", 0, c.strip(), -1) for c in line.strip().strip("|").split("|") if c.strip()]
        elif line.strip():
            body.append(line.strip())
        else:
            close()
    if fence and body:
        out.append(("code", 0, "\n".join(body), -1))
    else:
        close()
    return [(t, n, c if t == "code" else strip_inline(c), p) for t, n, c, p in out]


ADMONITIONS = ("NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION")
DELIMITED = {"----": "listing", "....": "literal", "====": "example", "****": "sidebar", "____": "blockquote", "++++": "pass", "////": "comment", "--": "open"}


def asciidoc(text: str) -> list[Block]:
    """A line machine with a stack of delimited blocks; verbatim blocks take their lines as they are."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # delimiter, type, index of the block
    body: list[str] = []
    style = ""

    def parent() -> int:
        return stack[-1][2] if stack else -1

    def close() -> None:
        nonlocal style
        if body:
            out.append((style or "paragraph", 0, strip_inline(" ".join(body)), parent()))
            body.clear()
        style = ""

    for line in text.splitlines():
        bare = line.rstrip()
        verbatim = stack and stack[-1][1] in ("listing", "literal", "pass", "comment")
        key = bare if bare in ("--", "|===") else bare[:4] if len(bare) >= 4 and len(set(bare)) == 1 else ""
        if stack and bare == stack[-1][0]:
            kind, at = stack[-1][1:]
            if verbatim:
                out[at] = (kind, 0, "\n".join(body), out[at][3])
                body.clear()
            else:
                close()
            stack.pop()
        elif verbatim:
            body.append(line)
        elif key in DELIMITED or key == "|===":
            named = style
            close()
            kind = named if named == "admonition" else DELIMITED.get(key, "table")
            out.append((kind, 0, "", parent()))
            stack.append((bare, kind, len(out) - 1))
        elif stack and stack[-1][1] == "table":
            out += [("table_cell", 0, strip_inline(c.strip()), parent()) for c in bare.split("|")[1:] if c.strip()]
        elif bare.startswith("//"):
            close()
        elif m := re.match(r"^(={1,6})\s+(.*)", bare):
            close()
            out.append(("heading", len(m[1]), strip_inline(m[2]), parent()))
        elif re.match(r"^:[\w-]+!?:", bare):
            close()
            out.append(("attribute", 0, bare, parent()))
        elif m := re.match(r"^\[(\w+)[^\]]*\]$", bare):
            close()
            style = "admonition" if m[1].upper() in ADMONITIONS else ""
        elif m := re.match(rf"^({'|'.join(ADMONITIONS)}):\s+(.*)", bare):
            close()
            out.append(("admonition", 0, strip_inline(m[2]), parent()))
        elif m := re.match(r"^\s*(\*+|-)\s+(.*)", bare):
            close()
            out.append(("list_item_unordered", len(m[1]), strip_inline(m[2]), parent()))
        elif m := re.match(r"^\s*(\.+|\d+\.)\s+(.*)", bare):
            close()
            out.append(("list_item_ordered", len(m[1]), strip_inline(m[2]), parent()))
        elif m := re.match(r"^(\S.*?)::\s*(.*)$", bare):
            if m[1] in ("include", "image", "xref"):
                continue
            close()
            out.append(("dlist", 0, strip_inline(f"{m[1]}: {m[2]}".strip()), parent()))
        elif bare.startswith(".") and len(bare) > 1 and bare[1] not in " .":
            close()
            out.append(("title", 0, strip_inline(bare[1:]), parent()))
        elif bare == "+":
            close()
        elif bare:
            body.append(bare.strip())
        else:
            close()
    while stack:  # a delimiter that never closes
        kind, at = stack[-1][1:]
        if kind in ("listing", "literal", "pass", "comment"):
            out[at] = (kind, 0, "\n".join(body), out[at][3])
            body.clear()
        stack.pop()
    close()
    return [b for b in out if b[0] != "comment"]


XML_TYPES = {"title": "heading", "para": "paragraph", "simpara": "paragraph", "p": "paragraph", "shortdesc": "paragraph", "cmd": "list_item_ordered", "info": "paragraph", "li": "list_item_unordered", "listitem": "list_item_unordered", "note": "admonition", "tip": "admonition", "warning": "admonition", "important": "admonition", "caution": "admonition", "programlisting": "code", "screen": "code", "codeblock": "code", "entry": "table_cell", "term": "dlist", "dt": "dlist", "dd": "dlist", "lq": "blockquote", "blockquote": "blockquote"}
XML_SKIPPED = {"prolog", "metadata", "info_meta", "related-links", "articleinfo", "bookinfo", "indexterm"}


def xml(text: str) -> list[Block]:
    """DocBook and DITA: an element of a known type is a block; its own text, without that of blocks inside of it."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "", text or "")
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return [("paragraph", 0, re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", text)).strip(), -1)] if text.strip() else []
    out: list[Block] = []

    def name(e: ElementTree.Element) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def own(e: ElementTree.Element) -> str:
        parts = [e.text or ""]
        for c in e:
            if name(c) not in XML_TYPES and name(c) not in XML_SKIPPED:
                parts.append(own(c))
            parts.append(c.tail or "")
        return "".join(parts)

    def walk(e: ElementTree.Element, depth: int, parent: int) -> None:
        tag = name(e)
        if tag in XML_SKIPPED:
            return
        at = parent
        if kind := XML_TYPES.get(tag):
            content = own(e).strip("\n") if kind == "code" else re.sub(r"\s+", " ", own(e)).strip()
            if content:
                out.append((kind, max(1, depth) if kind == "heading" else 0, content, parent))
                at = len(out) - 1
        for c in e:
            walk(c, depth + (tag in ("article", "book", "chapter", "section", "topic", "concept", "task", "reference")), at)

    walk(root, 0, -1)
    return out


def dita_topic(text: str) -> str:
    """concept, task, reference, map or topic, by the root element."""
    m = re.search(r"<(concept|task|reference|map|bookmap|topic)[\s>]", text or "")
    return {"bookmap": "map"}.get(m[1], m[1]) if m else ""


def docx(data: bytes) -> list[Block]:
    """Paragraph styles of a word-processor file; tables cell by cell."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    out: list[Block] = []
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{w}t"))
    for e in body if body is not None else ():
        if e.tag == f"{w}p" and said(e).strip():
            style = e.find(f"{w}pPr/{w}pStyle")
            style = (style.get(f"{w}val") if style is not None else "") or ""
            level = int(m[1]) if (m := re.search(r"(?i)heading\s?(\d)", style)) else 0
            kind = "heading" if level or style == "Title" else "list_item_ordered" if "Number" in style else "list_item_unordered" if e.find(f"{w}pPr/{w}numPr") is not None or "List" in style else "paragraph"
            out.append((kind, level, said(e).strip(), -1))
        elif e.tag == f"{w}tbl":
            out += [("table_cell", 0, said(c).strip(), -1) for c in e.iter(f"{w}tc") if said(c).strip()]
    return out


def pdf(data: bytes) -> list[Block]:
    """Text operators of uncompressed or deflated page streams; lines that recur on most pages go."""
    pages: list[list[str]] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        lines = []
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            said = "".join(re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1") for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", block))
            if said.strip():
                lines.append(said.strip())
        if lines:
            pages.append(lines)
    often = Counter(line for page in pages for line in set(page))
    repeated = {line for line, n in often.items() if len(pages) > 2 and n > len(pages) / 2}
    return [("paragraph", 0, line, -1) for page in pages for line in page if line not in repeated]


PARSERS: dict[str, Callable] = {"markdown": markdown, "asciidoc": asciidoc, "xml": xml, "dita": xml, "docx": docx, "pdf": pdf}


def blocks(docs: DataFrame, kind: str, id_col: str = "doc_id", content: str = "text") -> DataFrame:
    """Blocks of docs in one format; a document that cannot be parsed is one paragraph of its text."""
    parser = PARSERS[kind]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            rows = []
            for doc_id, data in zip(pdf_.iloc[:, 0], pdf_.iloc[:, 1], strict=True):
                try:
                    found = parser(data) if data is not None else []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    found = [("paragraph", 0, data if isinstance(data, str) else "", -1)]
                rows += [(doc_id, k, parent, t, level, text) for k, (t, level, text, parent) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "block_idx", "parent_idx", "block_type", "level", "content"])

    return docs.select(F.col(id_col).cast("long"), content).mapInPandas(parse, SCHEMA)


def plaintext(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Native: blank lines part blocks; short lines without an end mark are headings, bullets and numbers are list items."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n[ \t]*\n+")).alias("block_idx", "raw"))
    c = F.regexp_replace("raw", "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
    kind = (
        F.when(c.rlike("^[-*•] "), "list_item_unordered").when(c.rlike("^[0-9]+[.)] "), "list_item_ordered").when(c.rlike("^(?:    |\t)"), "code")
        .when((F.length(c) <= 80) & ~c.contains("\n") & ~c.rlike("[.!?:;,]$"), "heading").otherwise("paragraph")
    )
    return cut.select("doc_id", "block_idx", kind.alias("block_type"), F.when(kind == "heading", 1).otherwise(0).alias("level"), c.alias("content")).where("content <> ''")


def files(spark, path: str, most: int = 10 << 20) -> DataFrame:
    """(path, length, content) of files up to a size, with the format by name."""
    from ..operators.content import with_file_format

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most)
    return with_file_format(found.withColumn("_text", F.lit("")), "_text", "path").select("path", "length", "content", "file_type")
