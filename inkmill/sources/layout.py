"""PDF by layout: every run of text with its place is a row, and Spark tells furniture, headings and paragraphs apart.

`runs` reads files (plain or deflated streams, object streams, simple fonts in Latin-1, composite fonts by their ToUnicode map);
`lines` and `blocks` are windows within a document, one shuffle for all of them. A glyph is taken to be half its size wide.
Null or broken files give no runs; a document without runs gives no blocks. Encrypted files are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNS = "doc_id long, page int, pos int, x double, y double, size double, bold boolean, width double, page_width double, page_height double, text string"
#: Share of a page that is margin, pages that make a text furniture, size and share of width of a watermark,
#: ratio to the body's size that makes a heading, least sizes of the heading levels 1 to 5.
MARGIN, REPEATED, WATERMARK_SIZE, WATERMARK_WIDTH, HEADING_RATIO, LEVELS = 0.08, 3, 40.0, 0.5, 1.3, (24, 20, 16, 14, 12)
#: A line further below the last one than this many times its size begins a block.
GAP = 1.4
#: Rows of a batch of runs, bytes of text or of files that a worker turns into Python objects or gathers at once; one document at least.
BATCH_ROWS, BATCH_BYTES = 8192, 1 << 22
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s/\[\]()<>]*|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"][A-Za-z0-9*]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


_STREAM = re.compile(rb"stream\r?\n")
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_PAGES = re.compile(rb"/Type\s*/Pages\b")
_FONT = re.compile(rb"/Type\s*/Font\b")
_BOLD = re.compile(rb"/BaseFont\s*/\S*(?i:bold|black|heavy)")
_NAMED = re.compile(rb"(/[^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R")
_BOX = re.compile(rb"/MediaBox\s*\[\s*([-+.\d]+)\s+([-+.\d]+)\s+([-+.\d]+)\s+([-+.\d]+)")
#: First bytes of operands and of numbers.
_OPERAND, _NUMBER = frozenset(b"(<[]/+-.0123456789>"), frozenset(b"+-.0123456789")


def _inflated(body: bytes) -> bytes:
    m = _STREAM.search(body)
    end = body.find(b"endstream", m.end()) if m else -1
    if end < 0:
        return b""
    raw = body[m.end() : end]
    raw = raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw.endswith((b"\r", b"\n")) else raw
    return zlib.decompressobj().decompress(raw) if b"FlateDecode" in body[: m.start()] else raw


def _objects(data: bytes) -> dict[int, bytes]:
    found, at = {}, 0
    while (m := _OBJECT.search(data, at)) and (end := data.find(b"endobj", m.end())) >= 0:
        found[int(m[1])] = data[m.end() : end]
        at = end + len(b"endobj")
    for body in [b for b in found.values() if b"/ObjStm" in b]:
        inner, first = _inflated(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        heads = [int(n) for n in inner[:first].split()]
        starts = heads[1::2] + [len(inner) - first]
        found |= {n: inner[first + starts[k] : first + starts[k + 1]] for k, n in enumerate(heads[::2])}
    return found


@cache
def _entry(key: bytes) -> re.Pattern:
    return re.compile(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)")


def _refs(body: bytes, key: bytes) -> list[int]:
    m = _entry(key).search(body)
    return [int(n) for n in _REF.findall(m[1])] if m else []


def _pages(objects: dict[int, bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(page, what it inherits) in reading order; a node that comes again is not entered again."""
    roots = [n for n, b in objects.items() if _PAGES.search(b) and not _refs(b, b"Parent")]
    stack, seen = [(n, b"") for n in reversed(roots)], set()
    while stack:
        n, inherited = stack.pop()
        body = objects.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        if _PAGES.search(body):
            stack += [(k, body + inherited) for k in reversed(_refs(body, b"Kids"))]
        else:
            yield body, inherited


def _utf16(code: bytes) -> str:
    return code.decode("utf-16-be", "surrogatepass")


def _unicode_map(cmap: bytes) -> dict[int, str] | None:
    """Code to text by a ToUnicode map; None for the identity over all codes."""
    known: dict[int, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        known |= {int(a, 16): _utf16(bytes.fromhex(b.decode())) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            low, high, to = int(a, 16), int(b, 16), int(c, 16)
            if (low, high, to) == (0, 0xFFFF, 0):
                return None
            known |= {low + k: _utf16((to + k).to_bytes(max(2, len(c) // 2), "big")) for k in range(min(high - low, 0xFFFF) + 1)}
    return known


def _font(objects: dict[int, bytes], font: bytes) -> tuple[bool, bool, dict[int, str] | None]:
    """(bold, two bytes a code, code map)."""
    cmap = _refs(font, b"ToUnicode")
    return bool(_BOLD.search(font)), b"/Type0" in font, _unicode_map(_inflated(objects.get(cmap[0], b""))) if cmap else {}


def _fonts(objects: dict[int, bytes], page: bytes, read: dict[int, tuple]) -> dict[bytes, tuple[bool, bool, dict[int, str] | None]]:
    """name -> font; read: the file's fonts by number, each read once for all its pages."""
    resources = page + b"".join(objects.get(n, b"") for n in _refs(page, b"Resources"))
    resources += b"".join(objects.get(n, b"") for n in _refs(resources, b"Font"))
    out = {}
    for name, number in _NAMED.findall(resources):
        n = int(number)
        if name not in out and _FONT.search(objects.get(n, b"")):
            if n not in read:
                read[n] = _font(objects, objects[n])
            out[name] = read[n]
    return out


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = b"".join(token[1:-1].split())
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if b"\\" not in token:
        return token[1:-1]
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def _said(token: bytes, font: tuple) -> str:
    raw, (_, wide, known) = _bytes(token), font
    if known is None:
        return raw.decode("utf-16-be", "replace")
    codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)] if wide else list(raw)
    return "".join(known.get(c, "" if wide else chr(c)) for c in codes)


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    g, h, i, j, k, q = n
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + q


def _moved(x: float, y: float, n: tuple) -> tuple:
    a, b, c, d, e, f = n
    return a, b, c, d, x * a + y * c + e, x * b + y * d + f


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _page_runs(stream: bytes, fonts: dict) -> Iterator[tuple]:
    """(x, y, size, bold, width, text) of one page, as its operators place them."""
    ctm, kept, line, at, leading, size, font = _ONE, [], _ONE, _ONE, 0.0, 0.0, (False, False, {})
    args: list[bytes] = []
    for token in _TOKEN.findall(stream):
        if token[0] in _OPERAND:
            args.append(token)
            continue
        if token in (b"Tj", b"TJ", b"T*", b"'", b'"'):
            if token not in (b"Tj", b"TJ"):
                line = at = _moved(0.0, -leading, line)
            if token != b"T*":
                # A wide step back within an array of pieces is a space.
                text = "".join([_said(a, font) if a[:1] in b"(<" else " " if token == b"TJ" and a[:1] == b"-" and float(a) < -200 else "" for a in args])
                a, b, c, d, x, y = at if ctm is _ONE else _times(at, ctm)
                width = len(text) * size / 2
                if text.strip(" "):
                    yield x, y, size * math.hypot(c, d), font[0], width * abs(a), text
                at = _moved(width, 0.0, at)
            args = []
            continue
        number = [float(a) for a in args if a[0] in _NUMBER]
        if token == b"q":
            kept.append(ctm)
        elif token == b"Q" and kept:
            ctm = kept.pop()
        elif token == b"cm" and len(number) == 6:
            ctm = _times(tuple(number), ctm)
        elif token == b"BT":
            line = at = _ONE
        elif token == b"Tf" and number:
            size, font = number[-1], fonts.get(args[0], (False, False, {}))
        elif token == b"TL" and number:
            leading = number[0]
        elif token == b"Tm" and len(number) == 6:
            line = at = tuple(number)
        elif token in (b"Td", b"TD") and len(number) == 2:
            leading = -number[1] if token == b"TD" else leading
            line = at = _moved(*number, line)
        args = []


def _file_runs(data: bytes) -> Iterator[tuple]:
    objects, read = _objects(data), {}
    for number, (page, inherited) in enumerate(_pages(objects), 1):
        box = _BOX.search(page + inherited)
        left, low, right, high = (float(v) for v in box.groups()) if box else (0.0, 0.0, 612.0, 792.0)
        stream = b"\n".join(_inflated(objects.get(n, b"")) for n in _refs(page, b"Contents"))
        for pos, (x, y, size, bold, width, text) in enumerate(_page_runs(stream, _fonts(objects, page + inherited, read))):
            yield number, pos, x - left, y - low, size, bold, width, right - left, high - low, text


def _portions(batch: pa.RecordBatch, size_of: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some BATCH_BYTES by a column of sizes, one row at least: what a worker holds does not go by the batch."""
    begin = held = 0
    for k, size in enumerate(batch.column(size_of).to_pylist()):
        if held + (size or 0) > BATCH_BYTES and k > begin:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size or 0
    yield batch.slice(begin)


def runs(files: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """RUNS of every file; ids as they are, null ids too."""
    fields = [c.split() for c in RUNS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for part in _portions(batch, "_size"):
                for doc_id, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        rows += [(doc_id, *r) for r in _file_runs(data or b"")]
                    except (ValueError, TypeError, IndexError, OverflowError, zlib.error):  # a broken file
                        continue
                    for k in range(0, len(rows) - BATCH_ROWS + 1, BATCH_ROWS):
                        yield batch_of(rows[k : k + BATCH_ROWS])
                    rows = rows[len(rows) // BATCH_ROWS * BATCH_ROWS :]
        if rows:
            yield batch_of(rows)

    return files.select(F.col(id_col).cast("long"), content, F.octet_length(content).alias("_size")).mapInArrow(read, RUNS)


def lines(found: DataFrame) -> DataFrame:
    """Runs on one height are a line; lines with why they go: margin, repeated, watermark (null: kept)."""
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    higher = F.abs(F.col("y") - F.lag("y").over(page)) > 0.3 * F.col("size")
    # In the page's own order; a heading's size is its largest run's, and it is bold if most of its signs are.
    numbered = found.repartition("doc_id").withColumn("line", F.sum(F.coalesce(higher, F.lit(True)).cast("int")).over(page))
    chars = F.length("text")
    line = numbered.groupBy("doc_id", "page", "line").agg(
        F.min("x").alias("x"), F.max("y").alias("y"), F.max("size").alias("size"), (F.sum(F.when(F.col("bold"), chars).otherwise(0)) * 2 > F.sum(chars)).alias("bold"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "")).alias("text"),
    )
    place = ["doc_id", "text", F.round("y", 1)]
    first = F.row_number().over(Window.partitionBy(*place, "page").orderBy("line")) == 1
    pages = F.sum(F.col("first").cast("int")).over(Window.partitionBy(*place))
    dropped = (
        F.when((F.col("y") + F.col("size") > F.col("page_height") * (1 - MARGIN)) | (F.col("y") < F.col("page_height") * MARGIN), "margin")
        .when(F.col("pages") >= REPEATED, "repeated").when((F.col("size") >= WATERMARK_SIZE) & (F.col("width") > F.col("page_width") * WATERMARK_WIDTH), "watermark")
    )
    return line.withColumn("first", first).withColumn("pages", pages).withColumn("dropped", dropped).withColumn("left", F.min(F.when(F.col("size") < WATERMARK_SIZE, F.col("x"))).over(Window.partitionBy("doc_id"))).drop("first", "pages")


def blocks(found: DataFrame) -> DataFrame:
    """(doc_id, block_idx, page, block_type, level, content) of the lines that stay.

    A line begins a block if it is of another size or weight, is indented from the document's left edge, or stands further
    below than GAP; a paragraph runs on over a page's end otherwise. Headings are bold or HEADING_RATIO larger than the body,
    whose size is the one of most signs (ties: the smaller); their level goes by size.
    """
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("page", "line")
    kept = lines(found).where(F.col("dropped").isNull())
    signs = F.length(F.replace("text", F.lit(" "), F.lit("")))
    kept = kept.withColumn("size", F.round("size", 1)).withColumn("weight", F.sum(signs).over(Window.partitionBy("doc_id", "size")))
    kept = kept.withColumn("body", F.min(F.struct(-F.col("weight"), F.col("size"))).over(doc)["size"])
    before = lambda c: F.lag(c).over(order)
    styled = (F.col("size") != before("size")) | (F.col("bold") != before("bold"))
    apart = (F.col("page") == before("page")) & (F.abs(before("y") - F.col("y")) > GAP * F.col("size"))
    begins = F.coalesce(styled | apart | (F.col("x") > F.col("left") + F.col("size") / 2), F.lit(True))
    numbered = kept.withColumn("begins", begins).withColumn("block_idx", (F.sum(F.col("begins").cast("int")).over(order) - 1).cast("int"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda r: r["text"]), " ")
    whole = numbered.groupBy("doc_id", "block_idx").agg(F.min("page").alias("page"), F.first("size").alias("size"), F.first("bold").alias("bold"), F.first("body").alias("body"), said.alias("content"))
    heading = F.col("bold") | (F.col("size") >= HEADING_RATIO * F.col("body"))
    level = F.when(~heading, 0)
    for k, least in enumerate(LEVELS, 1):
        level = level.when(F.col("size") >= least, k)
    return whole.select("doc_id", "block_idx", "page", F.when(heading, "heading").otherwise("paragraph").alias("block_type"), level.otherwise(6).alias("level"), "content")


# -- sink: plain text as pages

#: Lines of a page, words of a line.
PAGE_LINES, LINE_WORDS = 24, 12
_IDENTITY = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end"


def _pdf(head: str, paragraphs: list[tuple[str, float, bool]]) -> bytes:
    """Pages of (text, size, bold), with a running head, page numbers and a watermark."""
    placed = []
    for text, size, bold in paragraphs:
        words = text.split(" ")
        placed += [(" ".join(words[k : k + LINE_WORDS]), size, bold, k == 0) for k in range(0, len(words), LINE_WORDS)]
    sheets = [placed[k : k + PAGE_LINES] for k in range(0, len(placed), PAGE_LINES)]
    fonts = b"<< /F1 3 0 R /F2 4 0 R /F3 5 0 R >>"
    composite = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /BaseFont /%s /ToUnicode 6 0 R >>"
    stream = lambda body, keys=b"": b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), keys, body)
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 612 792] /Resources << /Font %s >> >>" % (len(sheets), b" ".join(b"%d 0 R" % (7 + 2 * k) for k in range(len(sheets))), fonts),
             composite % b"Helvetica", composite % b"Helvetica-Bold", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", stream(_IDENTITY)]
    for number, sheet in enumerate(sheets, 1):
        out = [f"BT /F3 80 Tf 1 0 0 1 60 380 Tm (CONFIDENTIAL) Tj ET BT /F3 9 Tf 1 0 0 1 72 690 Tm ({head}) Tj ET BT /F3 9 Tf 72 30 Td (Page {number}) Tj ET BT 12 TL 72 670 Td"]
        for text, size, bold, first in sheet:
            step = f"18 -{24 if size < 24 else 36} Td" if first else "T*"
            out.append(f"/F{1 + bold} {size} Tf {step} <{text.encode('utf-16-be', 'surrogatepass').hex()}> Tj" + (" -18 0 Td" if first else ""))
        parts += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (8 + 2 * (number - 1)), stream(zlib.compress(("\n".join(out) + " ET").encode("ascii"), 1), b"/Filter /FlateDecode ")]
    data, places = b"%PDF-1.7\n", []
    for n, body in enumerate(parts, 1):
        places.append(len(data))
        data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    rows = b"".join(b"%010d 00000 n \n" % p for p in places)
    return data + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, rows, len(parts) + 1, len(data))


def render(docs: DataFrame) -> DataFrame:
    """(doc_id, content) of docs (doc_id, head, paragraphs of (text, size, bold)): a file each, whatever its length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _portions(batch, "_size"):
                listed = b.column(2)
                said = listed.flatten()
                rows = list(zip(*[said.field(k).to_pylist() for k in range(3)], strict=True))
                ends = pa.compute.cumulative_sum(pa.compute.list_value_length(listed)).to_pylist()
                files = [_pdf(head, rows[begin:end]) for head, begin, end in zip(b.column(1).to_pylist(), [0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["doc_id", "content"])

    size = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["text"]))
    return docs.select(F.col("doc_id").cast("long"), "head", F.transform("paragraphs", lambda p: F.struct(p["text"].alias("text"), p["size"].alias("size"), p["bold"].alias("bold"))).alias("paragraphs"), size.alias("_size")).mapInArrow(write, "doc_id long, content binary")
