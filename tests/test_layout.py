"""PDF by layout: own files with headings, margins, running heads, a watermark; codes and placements of real writers."""

import zlib

import pyarrow as pa

from inkmill.sources import layout

MAP = b"1 beginbfchar <01> <00480069> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange"


def made(pages, more=b""):
    """A file of content streams; F1 plain, F2 bold, F3 with a ToUnicode map."""
    out = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    out += b"2 0 obj\n<< /Type /Pages /MediaBox [0 0 600 800] /Kids [%s] >>\nendobj\n" % b" ".join(b"%d 0 R" % (20 + 2 * k) for k in reversed(range(len(pages))))
    out += b"3 0 obj\n<< /Font 4 0 R >>\nendobj\n4 0 obj\n<< /F1 5 0 R /F2 6 0 R /F3 7 0 R >>\nendobj\n"
    out += b"5 0 obj\n<< /Type /Font /BaseFont /Times >>\nendobj\n6 0 obj\n<< /Type /Font /BaseFont /Times-Bold >>\nendobj\n"
    out += b"7 0 obj\n<< /Type /Font /BaseFont /ABC+Own /ToUnicode 8 0 R >>\nendobj\n8 0 obj\n<< >>\nstream\n%s\nendstream\nendobj\n" % MAP
    for k, body in enumerate(pages):
        out += b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Resources 3 0 R /Contents [%d 0 R] >>\nendobj\n" % (20 + 2 * k, 21 + 2 * k)
        out += b"%d 0 obj\n<< /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (21 + 2 * k, zlib.compress(body))
    return out + more


def frame(spark, *files):
    return spark.createDataFrame([(k, f) for k, f in enumerate(files)], "doc_id long, content binary")


def said(spark, *files):
    return [tuple(r) for r in layout.blocks(layout.runs(frame(spark, *files))).orderBy("doc_id", "block_idx").collect()]


def test_operators_place_and_decode():
    page = rb"q 2 0 0 2 10 20 cm BT /F1 6 Tf 50 100 Td (a \(b\) \101) Tj 14 TL T* [(on) -300 (e) -50 (s)] TJ /F3 6 Tf (next) ' ET Q BT /F3 9 Tf 1 0 0 1 40 700 Tm <01 1011> Tj ET"
    found = list(layout._file_runs(made([page])))
    assert [(round(r[2]), round(r[3]), r[4], r[-1]) for r in found] == [(110, 220, 12.0, "a (b) A"), (110, 192, 12.0, "on es"), (110, 164, 12.0, "next"), (40, 700, 9.0, "Hiab")]
    assert found[0][7:9] == (600.0, 800.0)


def test_pages_in_the_order_of_the_tree_and_object_streams():
    heads = b"30 0 "
    inner = heads + b"<< /Type /Page /Parent 2 0 R /Resources 3 0 R /Contents 31 0 R >>"
    more = b"40 0 obj\n<< /Type /ObjStm /N 1 /First %d >>\nstream\n%s\nendstream\nendobj\n31 0 obj\n<< >>\nstream\nBT /F1 9 Tf (packed) Tj ET\nendstream\nendobj\n" % (len(heads), inner)
    data = made([b"BT /F1 9 Tf (last) Tj ET", b"BT /F2 9 Tf (first) Tj ET"], more).replace(b"/Kids [", b"/Kids [30 0 R ")
    assert [(r[0], r[5], r[-1]) for r in layout._file_runs(data)] == [(1, False, "packed"), (2, True, "first"), (3, False, "last")]
    looped = data.replace(b"/Kids [", b"/Kids [2 0 R ")
    assert len(list(layout._file_runs(looped))) == 3


def test_furniture_goes_and_headings_stay(spark):
    """Numbers in the margin, a head on three pages, a turned watermark; a paragraph runs on over the page's end."""
    page = lambda n, body: b"BT /F1 90 Tf 0.8 0.6 -0.6 0.8 80 200 Tm (TOP  SECRET DRAFT) Tj ET BT /F1 8 Tf 50 700 Td (The guide) Tj ET BT /F1 8 Tf 50 20 Td (%d) Tj ET BT 12 TL /F1 10 Tf 50 650 Td %s ET" % (n, body)
    bodies = [b"/F2 20 Tf (A title) Tj /F1 10 Tf 0 -30 Td (One line) Tj T* (goes on over) Tj", b"(the page.) Tj 15 -12 Td (Indented, so) Tj -15 0 Td T* (a new one.) Tj 0 -40 Td /F1 14 Tf (Large alone) Tj",
              b"(Some ) Tj /F2 10 Tf (bold) Tj /F1 10 Tf ( text in a line.) Tj 0 -40 Td (Apart.) Tj"]
    pages = [page(n, b) for n, b in enumerate(bodies, 1)]
    want = [("heading", 2, "A title", 1), ("paragraph", 0, "One line goes on over the page.", 1), ("paragraph", 0, "Indented, so a new one.", 2), ("heading", 4, "Large alone", 2),
            ("paragraph", 0, "Some bold text in a line.", 3), ("paragraph", 0, "Apart.", 3)]
    got = said(spark, made(list(reversed(pages))))
    assert [(r[3], r[4], r[5], r[2]) for r in got] == want
    why = {(r["dropped"], r["n"]) for r in layout.lines(layout.runs(frame(spark, made(pages)))).where("dropped IS NOT NULL").groupBy("dropped").count().withColumnRenamed("count", "n").collect()}
    # The watermark is on three pages at one height too: what repeats is asked first.
    assert why == {("margin", 3), ("repeated", 6)}
    # On two pages alone the head stays, and the watermark goes for its size.
    two = said(spark, made(list(reversed(pages[:2]))))
    assert [r[5] for r in two].count("The guide") == 2 and not any("SECRET" in r[5] for r in two)


def test_nulls_broken_files_and_no_files(spark):
    good = made([b"BT /F1 9 Tf 50 400 Td (whole) Tj ET"])
    broken = good.replace(b"/FlateDecode >>\nstream\n", b"/FlateDecode >>\nstream\nx")
    assert [(r[0], r[5]) for r in said(spark, None, b"", b"no file at all", broken, good, made([b"BT (no font) Tj ET", b"BT /F1 9 Tf 9 400 Td (   ) Tj ET"]))] == [(4, "whole")]
    assert layout.blocks(layout.runs(frame(spark, good).where("false"))).count() == 0
    unnamed = layout.blocks(layout.runs(frame(spark, good).selectExpr("CAST(NULL AS long) AS doc_id", "content", "1 AS page", "'x' AS text"))).collect()
    assert [(r["doc_id"], r["content"]) for r in unnamed] == [(None, "whole")]


def test_written_pages_come_back(spark):
    """Signs beyond Latin and beyond the first plane, brackets, a word longer than a page is wide."""
    rows = [(1, "Head (1)", [("Ünïcode \U0001f600 (x) \\ <y>", 24.0, True), ("w" * 3000, 11.0, False), ("日本 語", 16.0, False)]), (2, "None", [])]
    docs = spark.createDataFrame(rows, "doc_id long, head string, paragraphs array<struct<text string, size double, bold boolean>>")
    got = layout.blocks(layout.runs(layout.render(docs))).orderBy("block_idx").collect()
    assert [(r["doc_id"], r["block_type"], r["level"], r["content"]) for r in got] == [(1, "paragraph", 0, "Head (1)"), (1, "heading", 1, rows[0][2][0][0]), (1, "paragraph", 0, "w" * 3000), (1, "heading", 3, "日本 語")]


def test_workers_hold_portions_by_bytes_not_by_rows(spark, monkeypatch):
    """Whatever a batch brings, a worker turns some BATCH_BYTES of it into objects at once, one row at least, and gives no more than BATCH_ROWS runs at once."""
    sizes = [3, 3, 5, 20, None, 1, 9]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "_size": pa.array(sizes, pa.int64())})
    monkeypatch.setattr(layout, "BATCH_BYTES", 10)
    parts = [p.column("doc_id").to_pylist() for p in layout._portions(batch, "_size")]
    assert parts == [[0, 1], [2], [3], [4, 5, 6]]
    assert [p.num_rows for p in layout._portions(batch.slice(0, 0), "_size")] == [0]
    monkeypatch.undo()
    # A file of more runs than a batch of them, and files of nothing beside it.
    long = made([b"BT /F1 9 Tf 12 TL 50 700 Td " + b"(x) Tj T* " * (2 * layout.BATCH_ROWS + 5) + b"ET"])
    sizes = layout.runs(frame(spark, None, long, b"")).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(r["n"] for r in sizes) == 2 * layout.BATCH_ROWS + 5
