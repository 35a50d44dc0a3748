"""Offset maps against a map of single characters, and the cases of span remapping told plainly."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmill.operators import spanmaps as M
from inkmill.plans import spans

STEPS = [
    M.delete("#{1,3} "),
    M.keep("\\*", "[^*]+", "\\*"),
    M.fixed("`[^`]+`", "placeholder"),
    M.keep("\\[", "[^\\]]*", "\\]\\([^)]*\\)"),
    M.fixed(" {2,}", " "),
]
PUTS = [None, None, "placeholder", None, " "]


def slow_clean(text):
    """The cleaned text, and each character's (first, after last) in the source."""
    places = [(k, k + 1) for k in range(len(text))]
    for step, put in zip(STEPS, PUTS, strict=True):
        out, to, last = [], [], 0
        for m in re.finditer(step.pattern, text):
            out.append(text[last : m.start()])
            to += places[last : m.start()]
            if put is None:
                out.append(m[2])
                to += places[m.start(2) : m.end(2)]
            else:
                out.append(put)
                to += [(places[m.start()][0], places[m.end() - 1][1])] * len(put)
            last = m.end()
        text, places = "".join([*out, text[last:]]), to + places[last:]
    return text, places


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab #*`[]()é", max_size=40), min_size=1, max_size=12))
def test_composed_runs_are_the_map_of_characters(spark, texts):
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    clean, total = M.clean(docs, STEPS, ("doc_id",))
    asked = clean.select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("start")).withColumn("end", F.col("start") + 2)
    found = {(r.doc_id, r.start): (r.raw_start, r.raw_end) for r in M.lookup(asked, total, ("doc_id",)).collect()}
    cleaned = {r.doc_id: r.text for r in clean.collect()}
    for k, text in enumerate([*texts, ""]):
        want, places = slow_clean(text)
        assert cleaned[k] == want
        for at in range(len(want) + 1):
            begin = places[at][0] if at < len(want) else None
            assert found[k, at] == (begin, places[at + 1][1] if at + 1 < len(want) else None)


def _one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


@pytest.mark.parametrize(
    ("text", "flagged", "approx", "want"),
    [
        ("The quick brown fox", "quick", 0, (4, 9)),
        ("The Quick brown fox", "quick", 0, (4, 9)),  # without case
        ("use it and use it and use it", "use", 12, (11, 14)),  # the nearest of several
        ("use it and use it", "use", 0, (0, 3)),
        ("Click the button", "- Click the", 0, (0, 9)),  # list, number, heading and quote markers
        ("Click the button", "12. Click the", 0, (0, 9)),
        ("Click the button", "## Click the", 0, (0, 9)),
        ("nothing here", "absent", 0, (-1, -1)),
        ("x" * 3000 + " far away", "far away", 0, (3001, 3009)),  # beyond the window
        ("aaaa", "aa", 2, (2, 4)),  # overlapping places
        ("", "a", 0, (-1, -1)),
        ("abc", "", 0, (-1, -1)),
    ],
)
def test_looking_near_by(spark, text, flagged, approx, want):
    got = _one(spark, t=text, f=flagged, a=approx).select(M.refind(F.col("t"), F.col("f"), F.col("a")).alias("s")).head().s
    assert tuple(got) == want


def test_issues_of_html_land_on_the_pages_characters(spark, sf_dir):
    """A find's raw text is the find itself once its entities are undone."""
    undo = lambda t: t.replace("&amp;", "&").replace("&quot;", '"')
    rows = spans.html_issue_spans(spark, sf_dir).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) > 50 and any("&amp;" in r.raw_text for r in rows)
    assert all(undo(r.raw_text) == r.flagged and html[r.doc_id][r.raw_start : r.raw_end] == r.raw_text for r in rows)


def _code(spark, text):
    docs = _one(spark, doc_id=1, text=text)
    clean, total = M.clean(docs, [M.keep("\\*", "[^*]+", "\\*"), M.keep("`", "[^`]+", "`")], ("doc_id",))
    return clean, M.carried(M.ranges(docs, "`[^`]+`", ("doc_id",)), total, ("doc_id",))


@pytest.mark.parametrize(
    ("text", "ranges"),
    [
        ("Use the `oc` command.", [(8, 10)]),
        ("Run `a` then `bcd`.", [(4, 5), (11, 14)]),
        ("No code here.", []),
        ("*Bold* and `code`", [(9, 13)]),
        ("*`curl`* it", [(0, 4)]),
    ],
)
def test_code_ranges_in_the_cleaned_text(spark, text, ranges):
    assert sorted(map(tuple, _code(spark, text)[1].select("r_start", "r_end").collect())) == ranges


def test_finds_beside_code_stay_and_those_inside_go(spark):
    clean, code = _code(spark, "The color of `color` and *color* is `my color` color.")
    found = M.ranges(clean, "color", ("doc_id",)).withColumnsRenamed({"r_start": "start", "r_end": "end"})
    assert found.count() == 5
    assert sorted(r.start for r in M.outside(found, code, ("doc_id",)).collect()) == [4, 23, 41]


def test_merged_ranges(spark):
    rows = [(1, 5, 9), (1, 0, 3), (1, 3, 5), (1, 20, 30), (1, 22, 25), (2, 0, 1), (1, 31, 40)]
    got = M.merged(spark.createDataFrame(rows, "k long, r_start long, r_end long"), ("k",)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 9), (1, 20, 30), (1, 31, 40), (2, 0, 1)]


def test_a_long_guard_covers_many_bins(spark):
    issues = spark.createDataFrame([(1, k, k + 2) for k in range(0, 1000, 7)], "k long, start long, end long")
    guards = spark.createDataFrame([(1, 100, 900), (1, 300, 400), (2, 0, 1000)], "k long, r_start long, r_end long")
    assert sorted(r.start for r in M.outside(issues, guards, ("k",)).collect()) == [k for k in range(0, 1000, 7) if not 100 <= k < 900]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    clean, total = M.clean(none, STEPS, ("doc_id",))
    assert clean.count() == total.count() == 0


def test_traced_finds_are_those_of_the_map_of_characters(spark):
    texts = ["a *bb* `b` [ab](#)  b", "", "##  *a b*", "`a b` ab *`ba`* é [b](x) bb", "no hit", "# [*b*](a)  `b``b`"]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    found = lambda guard: sorted(map(tuple, M.traced(docs, STEPS, "[a-c]+", ("doc_id",), guard).collect()))
    want, guarded = [], []
    for k, text in enumerate(texts):
        cleaned, places = slow_clean(text)
        code = [m.span() for m in re.finditer("`[^`]+`", text)]
        for m in re.finditer("[a-c]+", cleaned):
            row = (k, m.start(), m.end(), m[0], places[m.start()][0], places[m.end() - 1][1])
            want.append(row)
            guarded += [] if any(a <= row[4] < b for a, b in code) else [row]
    assert len(want) > len(guarded) > 5
    assert found(None) == want and found("`[^`]+`") == guarded


def test_leaving_out_finds_that_change_nothing_gives_the_same_text(spark):
    pages = ["<p>a  b</p>\n\n<p> c </p><hr>d\t<b>e</b> f<!-- x --> g", " <div> <p>\r\n x</p> </div> ", "<p><p> <p>", "a&nbsp;\nb"]
    docs = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string")
    texts = lambda steps: sorted(map(tuple, M.clean(docs, steps, ("doc_id",))[0].collect()))
    assert texts(spans.HTML_CHANGES) == texts(spans.HTML_STEPS)


def test_a_texts_steps_are_run_in_one_projection(spark, sf_dir):
    """Each branch of the plan that read the texts ran all of their steps again."""
    plan = spans.html_issue_spans(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(spans.HTML_STEPS) + 1


def test_finds_of_several_patterns_move_no_text(spark):
    texts = ["ab b", "", "bb a", None, "xyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = M.finds_of(docs, ["b+", "a|b"], ("doc_id",))
    want = [(k, n, m.start(), m.end(), m[0]) for k, t in enumerate(texts) for n, p in enumerate(("b+", "a|b")) for m in re.finditer(p, t or "")]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
