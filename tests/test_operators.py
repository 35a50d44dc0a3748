import zipfile
import io
import zlib

import pytest
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.operators import content, merge
from inkmill.sources import connectors, html, parse, sinks


def test_text_primitives(spark):
    row = spark.createDataFrame([("a\r\nb\tc   d. E! f\n\n g",)], "t string")
    got = row.select(T.normalize_whitespace("t").alias("n"), T.collapse("t").alias("c"), T.utf16_to_code_point(F.lit("😀ab"), F.lit(3)).alias("u")).head()
    assert got.n == "a\nb c d. E! f\n\n g" and got.c == "a b c d. E! f g" and got.u == 2
    docs = spark.createDataFrame([(1, "One. Two! x\n\n Three"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.sentence) for r in T.sentences(docs).orderBy("doc_id", "sent_idx").collect()] == [(1, "One."), (1, "Two!"), (1, "x"), (1, "Three")]
    words = spark.createDataFrame([("make",), ("table",), ("rhythm",), ("reading",), ("b",)], "w string")
    assert [r[0] for r in words.select(T.syllables(F.col("w"))).collect()] == [1, 2, 1, 2, 1]


def test_finds(spark):
    row = spark.createDataFrame([("éx1x22",)], "t string").select(T.finds("t", "[0-9]+").alias("f")).head()
    assert [(x.start, x.end, x.hit) for x in row.f] == [(2, 3, "1"), (4, 6, "22")]


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([("style", "a", 0, 0, 10), ("style", "b", 0, 4, 14), ("style", "c", 0, 11, 20)], [0, 2]),  # a dropped issue suppresses nothing
        ([("style", "a", 0, 0, 10), ("style", "b", 0, 5, 15)], [0, 1]),  # half is not more than half
        ([("style", "a", 0, 0, 4), ("grammar", "a", 0, 0, 4)], [0, 1]),
        ([("style", "a", 0, 0, 4), ("word-usage", "a", 0, 9, 12), ("style", "a", 1, 0, 4)], [0, 2]),
        ([], []),
        ([("other", "x y", 0, 0, 3), ("other", "y x", 0, 1, 3), ("other", "X Y ", 0, 9, 12), ("other", "", 0, 4, 4)], [0, 3]),
    ],
)
def test_accept(spark, rows, kept):
    schema = "doc_id long, ord int, category string, flagged string, sent_idx int, start_pos int, end_pos int"
    issues = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], schema)
    assert sorted(r.ord for r in merge.merge(issues).collect()) == kept


def test_merge_and_demote(spark):
    schema = "doc_id long, ord int, category string, flagged string, sent_idx int, start_pos int, end_pos int, suggestions array<string>"
    issues = spark.createDataFrame([(1, 1, "style", "a", 0, 0, 10, ["x"]), (1, 2, "style", "b", 0, 2, 9, ["y"]), (2, 1, "style", None, 0, 0, 4, [])], schema)
    assert sorted((r.doc_id, r.ord) for r in merge.merge(issues).collect()) == [(1, 1), (2, 1)]
    out = {(r.doc_id, r.ord): r.suggestions for r in merge.demote(issues, spark.createDataFrame([(1, 9)], "doc_id long, end_pos int")).collect()}
    assert out[1, 1] == [] and out[1, 2] == ["y"]


def test_resolve_and_suggestions(spark):
    rows = spark.createDataFrame([("Go. We see it.", "We see it.", "see"), ("abc", "zzz", "bc"), ("abc", "zzz", "q")], "text string, sentence string, flagged string")
    assert [(r.start_pos, r.end_pos) for r in merge.resolve(rows).collect()] == [(7, 10), (1, 3), (0, 0)]
    out = spark.createDataFrame([("Foo", ["Use x", "bar", "y" * 30])], "flagged string, s array<string>").select(merge.scrub_suggestions("s").alias("s"), merge.match_case(F.col("flagged"), F.lit("bar")).alias("m")).head()
    assert out.s == ["bar"] and out.m == "Bar"


def test_formats_and_types(spark):
    rows = spark.createDataFrame([("= Title\n\n:attr: x\n", "a.adoc"), ("# T\n\n```\nx\n```", ""), ("<!DOCTYPE html><p>x", ""), ("plain", "x.txt"), ("", "f.pdf"), ("<!DOCTYPE task><task><taskbody/></task>", "")], "t string, f string")
    assert [r[0] for r in content.with_file_format(rows, "t", "f").select("file_type").collect()] == ["asciidoc", "markdown", "html", "plaintext", "pdf", "dita"]
    types = spark.createDataFrame([("1. Click it\n2. Go",), ("An overview of it",), ("| a | b |",), ("",), (":_content-type: reference",)], "t string")
    assert [r[0] for r in content.with_content_type(types, "t").select("content_type").collect()] == ["procedure", "concept", "reference", "concept", "reference"]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "aaaa\nbbbb\ncccc\n\ndd"), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in content.chunks(docs, limit=8).orderBy("doc_id", "chunk").collect()] == [(1, 0, 0, 1, 0, 8), (1, 1, 2, 3, 2, 6)]


def test_repair():
    assert content.repair('```json\n[{"a": 1},]\n```') == [{"a": 1}]
    assert content.repair('[{"a": 1}, {"b": 2}, {"c": ') == [{"a": 1}, {"b": 2}]
    assert content.repair("") == content.repair(None) == content.repair("no") == []


def test_closest(spark):
    assert content.closest("the quick brown fox", "quick brwn") == (4, 14)
    assert content.closest("abc", "zzz") is None and content.closest("", "a") is None
    assert [tuple(r) for r in content.fuzzy_spans(spark.createDataFrame([(1, "hello world", "helo w"), (2, None, "x")], "id long, text string, wanted string")).collect()][1] == (2, -1, -1)


def test_html_blocks(spark):
    page = "<html><head><title>T</title></head><body><h1>A &amp; b</h1><p>x <b>y</b><!-- c --><ul><li>i<ol><li>j</ol></ul><script>p</script><pre>z</pre>"
    got = [(r.block_type, r.level, r.content) for r in html.blocks(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("block_idx").collect()]
    assert got == [("heading", 1, "A & b"), ("paragraph", 0, "x y"), ("list_item_unordered", 0, "i"), ("list_item_ordered", 0, "j"), ("listing", 0, "z")]


def test_markdown():
    assert parse.markdown("# H\n\npara `x`\nmore\n\n- i\n1. j\n\n> q\n\n| a | b |\n|---|---|\n\n```\ncode\n```\n") == [
        ("heading", 1, "H", -1), ("paragraph", 0, "para x more", -1), ("list_item_unordered", 0, "i", -1), ("list_item_ordered", 0, "j", -1),
        ("blockquote", 0, "q", -1), ("table_cell", 0, "a", -1), ("table_cell", 0, "b", -1), ("code", 0, "code", -1),
    ]


def test_asciidoc():
    got = parse.asciidoc("= T\n:a: b\n\n// no\nPara *x*\nmore\n\n[NOTE]\n====\nInside.\n====\n\nTIP: short\n\n----\ncode *y*\n----\n\n* i\n. j\nterm:: def\n\n|===\n|a |b\n|===\n")
    assert got == [
        ("heading", 1, "T", -1), ("attribute", 0, ":a: b", -1), ("paragraph", 0, "Para x more", -1), ("admonition", 0, "", -1), ("paragraph", 0, "Inside.", 3),
        ("admonition", 0, "short", -1), ("listing", 0, "code *y*", -1), ("list_item_unordered", 1, "i", -1), ("list_item_ordered", 1, "j", -1),
        ("dlist", 0, "term: def", -1), ("table", 0, "", -1), ("table_cell", 0, "a", 10), ("table_cell", 0, "b", 10),
    ]


def test_xml_and_dita():
    got = parse.xml("<?xml version='1.0'?><article><title>T</title><section><title>S</title><para>a <b>c</b> d</para><note><para>n</para></note></section></article>")
    assert [(b[0], b[1], b[2]) for b in got] == [("heading", 1, "T"), ("heading", 2, "S"), ("paragraph", 0, "a c d"), ("paragraph", 0, "n")]
    assert parse.dita_topic("<task id='x'>") == "task" and parse.xml("<a><b></a>") and parse.xml("") == []


def test_docx_and_pdf():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f"<w:document xmlns:w='{w}'><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>p</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", doc)
    assert parse.docx(buffer.getvalue()) == [("heading", 1, "H", -1), ("paragraph", 0, "p", -1), ("table_cell", 0, "c", -1)]
    page = lambda s: b"stream\n" + zlib.compress(b"BT (Head) Tj ET BT (" + s + b") Tj ET") + b"\nendstream\n"
    assert [b[2] for b in parse.pdf(page(b"one") + page(b"two") + page(b"three"))] == ["one", "two", "three"]


def test_parse_blocks_and_maps(spark):
    docs = spark.createDataFrame([(1, "# A\n\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.block_type) for r in parse.blocks(docs, "markdown").collect()] == [(1, "heading"), (1, "paragraph")]
    text, places = parse.strip_with_map("a `b` *c*")
    assert text == "a b c" and places == [0, 1, 3, 5, 7]
    assert [r.block_type for r in parse.plaintext(spark.createDataFrame([(1, "Title\n\nSome text.\n\n- item")], "doc_id long, text string")).orderBy("block_idx").collect()] == ["heading", "paragraph", "list_item_unordered"]


def test_connector(spark):
    said = lambda texts: [[{"offset": 3, "length": 2, "rule_id": "X", "replacements": list("abcdefg")}, {"offset": 0, "length": 1, "rule_id": "WHITESPACE_RULE"}] for _ in texts]
    docs = spark.createDataFrame([(1, "😀 teh")], "doc_id long, text string")
    assert [(r.start, r.end, len(r.replacements)) for r in connectors.check(docs, said).collect()] == [(2, 4, 5)]
    assert connectors.check(docs).count() == 0 and list(connectors.batches(["a" * 4, "b" * 4, "c" * 9], 8)) == [[0, 1], [2]]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.write_run(rows, f"{tmp_path}/r", "one", True)
    assert sinks.read_run(spark, f"{tmp_path}/r", "one").count() == 1
    sinks.write_run(rows.unionByName(rows), f"{tmp_path}/r", "one", False)
    assert sinks.read_run(spark, f"{tmp_path}/r", "one").count() == 2
    assert sorted(r.v for r in sinks.upsert(spark.createDataFrame([(1, "o"), (2, "p")], "k int, v string"), rows, "k").collect()) == ["a", "p"]
    assert "<h1>90" in sinks.report_html(90, "Excellent", {"style": 2}, ["x"])


def test_references(spark):
    from inkmill.operators import references

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a"), ("c", "x"), ("f", "g"), ("g", "f")], "source string, target string")
    assert {(r.node, r.length) for r in references.cycles(edges).collect()} == {("a", 3), ("b", 3), ("c", 3), ("d", 1), ("f", 2), ("g", 2)}
    assert [r.target for r in references.broken(edges, spark.createDataFrame([(c,) for c in "abcdfg"], "anchor string")).collect()] == ["x"]
