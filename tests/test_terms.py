"""Inflected terms, the longest find, exceptions, protected names and case, told in plain terms."""

from inkmill.operators import lexicons, terms
from inkmill.operators.rules import lexicon_issues

LEX = [("r", "log in", "sign in", "low", False), ("r", "log in to", "open", "low", False), ("r", "to the", "x", "low", False), ("r", "in", "within", "low", False), ("s", "log", "record", "low", False),
       ("r", "kill", "stop", "high", False), ("r", "utilizes", "uses", "low", False)]


def found(spark, texts, exceptions=(("none", "none"),), protected=("none such",)):
    sents = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, sent_idx int, sentence string")
    rows = terms.guarded(sents, spark.createDataFrame(LEX, lexicons.SCHEMA), spark.createDataFrame(list(exceptions), "rule_type string, term string"), spark.createDataFrame([(p,) for p in protected], "term string"))
    return sorted((r["sent_idx"], r["start"], r["end"], r["rule_name"], r["flagged"], r["replacement"]) for r in rows.collect())


def test_longest_from_the_left(spark):
    """'log in to' beats 'log in' and 'in', and 'to the' overlaps it; another rule's 'log' is its own matter."""
    assert found(spark, ["Log in to the kill, in.", None, ""]) == [(0, 0, 3, "s", "Log", "Record"), (0, 0, 9, "r", "Log in to", "Open"), (0, 14, 18, "r", "kill", "stop"), (0, 20, 22, "r", "in", "within")]


def test_a_find_after_a_lost_one_stays(spark):
    """'b c' loses to 'a b', so 'c d', which overlaps the lost one alone, is kept."""
    sents = spark.createDataFrame([(1, 0, "a b c d")], "doc_id long, sent_idx int, sentence string")
    lex = spark.createDataFrame([("r", t, "", "low", False) for t in ("a b", "b c", "c d")] + [("r", "a b", "!", "low", False)], lexicons.SCHEMA)
    kept = terms.longest(lexicon_issues(sents, lex).drop("sentence"), ("doc_id", "sent_idx")).orderBy("start").collect()
    assert [(r["flagged"], r["replacement"]) for r in kept] == [("a b", ""), ("c d", "")]


def test_exceptions_and_names(spark):
    """An exception of one rule leaves the other rules; a find within a name goes, one that runs out of it stays."""
    text = "Kill Switch can kill, LOG IN to it."
    assert [(r[1], r[4]) for r in found(spark, [text])] == [(0, "Kill"), (16, "kill"), (22, "LOG"), (22, "LOG IN to")]
    assert [(r[1], r[4]) for r in found(spark, [text], protected=["kill switch"])] == [(16, "kill"), (22, "LOG"), (22, "LOG IN to")]
    assert [(r[1], r[4]) for r in found(spark, [text], exceptions=[("r", "KILL"), ("*", "log")])] == [(22, "LOG IN to")]
    # 'log in' is not flagged where the longer term is excepted.
    assert [(r[1], r[4]) for r in found(spark, [text], exceptions=[("r", "log in to"), ("s", "kill")], protected=["log"])] == [(0, "Kill"), (16, "kill")]


def test_no_rows(spark):
    assert found(spark, []) == []


def test_forms():
    assert lexicons.forms("utilize", True) == ("utilizes", "utilized", "utilizing")
    assert lexicons.forms("try", True) == ("tries", "tried", "trying") and lexicons.forms("display", True) == ("displays", "displayed", "displaying")
    assert lexicons.forms("get", True) == ("gets", "got", "getting") and lexicons.forms("box", False) == ("boxes",)
    made = {(r[0], r[1]): r[2] for r in lexicons.inflected(lexicons.rows())}
    assert made["word_usage_u", "utilizing"] == "using" and made["simple_words", "obtained"] == "got" and made["inclusive_language", "blacklists"] == "blocklists"
    assert made["simple_words", "determines"] == "finds" and made["simple_words", "purchased"] == "bought"
    named = {t for t in (lexicons.VERBS + " " + lexicons.NOUNS).split()}
    assert named <= {r[1] for r in lexicons.rows()}
    assert len(made) == len(lexicons.inflected(lexicons.rows())) or len(lexicons.rows()) != len({r[:2] for r in lexicons.rows()})


def test_terms_and_names_are_looked_up_in_one_pass(spark):
    """Each text is read once, though names, overlapping finds and those that stand alone are all told apart."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(k, 0, "Kill Switch can kill, LOG IN to the end; utilizes.") for k in range(40)]
    sents = spark.createDataFrame(rows, "doc_id long, sent_idx int, sentence string").repartition(4).mapInArrow(counted, "doc_id long, sent_idx int, sentence string")
    got = terms.guarded(sents, spark.createDataFrame(LEX, lexicons.SCHEMA), spark.createDataFrame([("none", "none")], "rule_type string, term string"), spark.createDataFrame([("kill switch",)], "term string")).collect()
    assert sorted((r["start"], r["flagged"]) for r in got if r["doc_id"] == 7) == [(16, "kill"), (22, "LOG"), (22, "LOG IN to"), (41, "utilizes")]
    assert len(got) == 160 and seen.value == 40


def test_names_of_one_start_and_null_keys(spark):
    """A name that begins where the find does holds it; an outer name goes on holding after a shorter one; a null text has no names."""
    text = "kill all in the log"
    assert [(r[1], r[4]) for r in found(spark, [text], protected=["kill all in the log", "all"])] == []
    assert [(r[1], r[4]) for r in found(spark, [text], protected=["kill all", "in"])] == [(16, "log")]
    sents = spark.createDataFrame([(None, 0, text)], "doc_id long, sent_idx int, sentence string")
    rows = terms.guarded(sents, spark.createDataFrame(LEX, lexicons.SCHEMA), spark.createDataFrame([("none", "none")], "rule_type string, term string"), spark.createDataFrame([("kill",)], "term string")).collect()
    assert sorted(r["flagged"] for r in rows) == ["in", "kill", "log"]
