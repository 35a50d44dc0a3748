"""The state machines over blocks, the merge's base and the lexicons, by cases told in plain terms."""

import pytest

from inkmill.operators import lexicons
from inkmill.plans import fixtures, shared

WANTED = {
    "procedure_step_count": {(-1001, 5, 12)},
    "prerequisites_position": {(-1002, 6, 4)},
    "admonition_stacking": {(-1002, 8, 3)},
    "admonition_placement": {(-1002, 0)},
    "heading_level_skip": {(-1003, 1, 3, 1)},
    "unit_consistency": {(-1004, 6)},
    "paragraph_indent": {(-1003, 3)},
    "admonitions": {(-1003, 4)},
}


@pytest.mark.parametrize("name", WANTED)
def test_state_machines(spark, sf_dir, name):
    """Own structures are flagged where they should be; pages have none of these flaws."""
    assert {tuple(r) for r in shared.run(name, spark, sf_dir).collect()} == WANTED[name]


def test_where_list_flags_the_first_item_only(spark, sf_dir):
    assert [(r.doc_id, r.block_idx) for r in shared.run("where_list", spark, sf_dir).collect()] == [(-1004, 4)]


def test_verified_procedures_are_left_alone(spark, sf_dir):
    found = {r.doc_id for r in shared.run("verification_section", spark, sf_dir).collect()}
    assert -1001 not in found and {-1002, -1007} <= found and not found & {-1003, -1004, -1005, -1006}


def test_acronyms_take_the_last_full_name(spark, sf_dir):
    found = {(r.doc_id, r.acronym): r.full_name for r in shared.run("acronyms", spark, sf_dir).collect()}
    assert found[-2001, "API"] == "The Application Programming Interface" and found[-2002, "GUI"] == "The Great Unified Index"
    undefined = {(r.doc_id, r.acronym) for r in shared.run("undefined_acronyms", spark, sf_dir).collect()}
    assert {(-2002, "TLA"), (-2002, "API")} <= undefined and (-2001, "CPU") not in undefined


def test_issues_have_their_true_spans(spark, sf_dir):
    shared._views(spark, sf_dir, "issues")
    rows = spark.sql("SELECT s.sentence, i.* FROM raw_issues AS i JOIN sentences AS s ON i.doc_id = s.doc_id AND i.sent_idx = s.sent_idx").collect()
    assert rows and all(r.sentence[r.start_pos : r.end_pos] == r.flagged for r in rows)
    assert {r.flagged for r in rows if r.doc_id == -2003} >= {"In order to", "utilize", "colour", "grey", "leverage", "a lot"}


def test_no_everyday_word_is_a_term():
    common = {"the", "of", "and", "to", "in", "is", "are", "was", "that", "this", "it", "for", "with", "or", "on", "by", "as", "at", "from", "is to", "be", "an", "a"}
    terms = {r[1] for r in lexicons.rows()}
    assert not terms & common and len(terms) > 800


def test_fixtures_are_apart_from_the_tables():
    assert all(d < 0 for d in (*fixtures.STRUCTURES, *fixtures.PROSE))
