"""Every check flags its specimen and leaves its guard's specimen alone."""

import pytest

from inkmill.functions import text as T
from inkmill.operators import lexicons
from inkmill.operators.rule_table import ANY_LANGUAGE, RULE_TYPES, RULES, category
from inkmill.operators.rules import applicable, excepted, lexicon_issues, outside, pattern_issues


@pytest.fixture(scope="module")
def flagged(spark):
    prose = [(k, s, i) for k, r in enumerate(RULES) if not r.blocks for s, i in ((r.yes, 1), (r.no, 0))]
    rows = spark.createDataFrame(prose, "k int, sentence string, yes int")
    found = {(r.k, r.yes, r.check, r.rule_name) for r in pattern_issues(rows).select("k", "yes", "check", "rule_name").collect()}
    block = spark.createDataFrame([(k, r.blocks[0], s, i) for k, r in enumerate(RULES) if r.blocks for s, i in ((r.yes, 1), (r.no, 0))], "k int, block_type string, sentence string, yes int")
    return found | {(r.k, r.yes, r.check, r.rule_name) for r in pattern_issues(block, tuple(r for r in RULES if r.blocks), "block_type").collect()}


@pytest.mark.parametrize("k", range(len(RULES)), ids=[f"{r.rule_type}-{r.check}" for r in RULES])
def test_specimens(flagged, k):
    r = RULES[k]
    assert (k, 1, r.check, r.rule_type) in flagged, f"{r.yes!r} is not flagged"
    assert (k, 0, r.check, r.rule_type) not in flagged, f"{r.no!r} is flagged"


def test_spans_point_at_the_flagged_text(spark):
    rows = spark.createDataFrame([(1, "Éa  bb ... x 😀 then  we  go!! e.g. so"), (2, ""), (3, "e.g.")], "k int, sentence string")
    found = pattern_issues(rows).collect()
    assert found
    text = {1: "Éa  bb ... x 😀 then  we  go!! e.g. so", 2: "", 3: "e.g."}
    assert all(text[r.k][r.start : r.end] == r.flagged for r in found)
    assert not [r for r in found if r.k == 2]


def test_word_lists(spark):
    lex = lexicons.builtin(spark)
    rows = spark.createDataFrame([(1, "In order to Utilize a lot of data."), (2, None)], "doc_id long, text string")
    found = {(r.rule_name, r.flagged, r.pos) for r in lexicon_issues(T.sentences(rows), lex).collect()}
    assert ("word_usage_i", "In order to", 0) in found and ("word_usage_u", "Utilize", 3) in found and ("word_usage_a", "a lot", 4) in found


def test_every_letter_has_a_word_list():
    assert {f"word_usage_{c}" for c in "abcdefghijklmnopqrstuvwxyz"} <= {r[0] for r in lexicons.rows()}


def test_categories():
    assert category("word_usage_a") == "word-usage" and category("references_citations") == "references"
    assert category("punctuation_and_symbols") == category("list_punctuation") == "punctuation" and category("verbs") == "style"
    assert len(RULE_TYPES) == len(set(RULE_TYPES))


def test_parity_leaves_dormant_rules_out(spark):
    rows = spark.createDataFrame([("It doesn't start... ok.",)], "sentence string")
    assert "contractions" in {r.rule_name for r in pattern_issues(rows).collect()}
    assert "contractions" not in {r.rule_name for r in pattern_issues(rows, parity=True).collect()}


def test_exceptions_and_ranges(spark):
    rows = pattern_issues(spark.createDataFrame([(1, "Wait... and go!!")], "doc_id long, sentence string"))
    skip = spark.createDataFrame([("...", "ellipses"), ("!!", "*")], "term string, rule_type string")
    assert {r.rule_name for r in excepted(rows, skip).collect()} & {"ellipses", "tone", "exclamation_points"} == set()
    ranges = spark.createDataFrame([(1, 0, 8)], "doc_id long, r_start int, r_end int")
    assert "ellipses" not in {r.rule_name for r in outside(rows, ranges, ("doc_id",)).collect()}


def test_applicable_rules(spark):
    blocks = spark.createDataFrame([(1, 0, "heading"), (1, 1, "code"), (1, 2, "odd")], "doc_id long, block_idx int, block_type string")
    rules = spark.createDataFrame([("heading", "headings"), ("heading", "verbs"), ("paragraph", "verbs")], "block_type string, rule_type string")
    no = spark.createDataFrame([("heading", "verbs")], "block_type string, rule_type string")
    assert {(r.block_idx, r.rule_type) for r in applicable(blocks, rules, no, ("code",)).collect()} == {(0, "headings"), (2, "verbs")}


def test_rules_about_english_leave_other_languages_alone(spark):
    rows = [(1, "en", "They don't... wait!!"), (2, "de", "They don't... wait!!"), (3, None, "They don't... wait!!")]
    found = pattern_issues(spark.createDataFrame(rows, "doc_id long, lang string, sentence string")).collect()
    names = {d: {r.rule_name for r in found if r.doc_id == d} for d in (1, 2, 3)}
    assert names[1] == names[3] and "contractions" in names[1]
    assert names[2] == {n for n in names[1] if n in ANY_LANGUAGE} and {"ellipses", "exclamation_points"} <= names[2]
