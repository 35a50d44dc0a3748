"""Lexicon terms of any number of words are matched."""

import re

from inkmill.functions import text as T
from inkmill.operators import lexicons, rules
from inkmill.operators.rules import lexicon_issues


def test_a_term_of_seven_words(spark, tmp_path):
    (tmp_path / "own.csv").write_text("rule_type,term,replacement,severity,case_sensitive\nwordy,on the basis of the fact that,because,low,false\nwordy,utilize,use,low,false\n")
    docs = spark.createDataFrame([(1, "We stay on the Basis of the fact that we utilize it.")], "doc_id long, text string")
    found = {(r.flagged, r.pos) for r in lexicon_issues(T.sentences(docs), lexicons.read(spark, str(tmp_path)), fixed=False).collect()}
    assert found == {("on the Basis of the fact that", 2), ("utilize", 10)}
    assert lexicon_issues(T.sentences(docs), spark.createDataFrame([], lexicons.SCHEMA)).count() == 0


def test_only_words_that_open_a_term_become_rows(spark):
    lex = spark.createDataFrame([("a", "1", 1, None), ("b", "in", 2, "order"), ("b", "in", 4, "order")], "r string, _first string, _n int, _second string")
    opens = rules._openings(lex)
    at = spark.sql("SELECT array('In', '1', 'in', 'ORDER', 'order', 'in') AS _all").selectExpr(f"filter(transform(_all, (w, i) -> CASE WHEN {opens} THEN i END), x -> x IS NOT NULL) AS at")
    assert at.collect()[0]["at"] == [1, 2]
    assert rules._openings(lex.where("false")) == "false"


def test_places_in_a_sentence_of_many_pieces(spark):
    """Spans over pieces' ends, with gaps of several signs."""
    text = "".join(f"w{k}{' ,;'[: 1 + k % 3]} in  order" + " " * (1 + k % 2) for k in range(200))
    got = lexicon_issues(spark.createDataFrame([(text,)], "sentence string"), spark.createDataFrame([("b", "in order", "to", "low", False)], lexicons.SCHEMA)).orderBy("pos").collect()
    assert [(r["start"], r["end"]) for r in got] == [m.span() for m in re.finditer("in  order", text)] and [r["pos"] for r in got] == [3 * k + 1 for k in range(200)]


def test_only_spaces_tabs_and_line_ends_are_stripped(spark):
    """A separator at the end is not a line end; as in DuckDB."""
    got = spark.createDataFrame([(" \t a b \r\n",), ("a \u2028",), (" \n",), (None,)], "s string").select(T.strip("s").alias("s")).collect()
    assert [r["s"] for r in got] == ["a b", "a \u2028", "", None]
