"""Rule execution: all pattern checks in one pass over the sentences, all word lists in one join.

`pattern_issues` builds one array expression for all the checks asked for and explodes it once, so the sentences are
scanned once however many rules run; most sentences are let go by the gates of gates.py. `lexicon_issues` explodes the words once and joins them with the terms' first words; the built-in one is broadcast (its size is fixed), any other one as Spark decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import gates
from .rule_table import RULES, Rule, category, english

ISSUE = "rule_name string, check string, category string, severity string, start int, `end` int, flagged string, message string"
NEIGHBOUR = "[\\p{L}\\p{N}_]"


EMPTY = f"cast(array() AS array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in ISSUE.split(','))}>>)"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def issues_of(rule: Rule, text: str) -> str:
    """SQL: array<struct> of one check's issues in a sentence; blocks are the caller's business.

    SQL text, because a hundred checks built call by call take longer to build than to run. A sentence without a find
    costs one search.
    """
    p = _lit(rule.pattern)
    gates = [f"regexp_like({text}, {p})"] + ([f"regexp_like({text}, {_lit(rule.has)})"] if rule.has else []) + ([f"NOT regexp_like({text}, {_lit(rule.lacks)})"] if rule.lacks else [])
    left, right = f"CASE WHEN x.start > 0 THEN substring({text}, x.start, 1) ELSE '' END", f"substring({text}, x.`end` + 1, 1)"
    tests = [f"NOT regexp_like({side}, {_lit(signs)})" for signs, side in ((NEIGHBOUR * rule.word, left), (NEIGHBOUR * rule.word, right), (f"[{rule.before}]" * bool(rule.before), left), (f"[{rule.after}]" * bool(rule.after), right)) if signs]
    tests += [f"lower(x.hit) {no}IN ({', '.join(map(_lit, texts))})" for texts, no in ((rule.only, ""), (rule.never, "NOT ")) if texts]
    found = T.finds_sql(text, p)
    if tests:
        found = f"filter({found}, x -> {' AND '.join(tests)})"
    names = f"{_lit(rule.rule_type)} AS rule_name, {_lit(rule.check)} AS `check`, {_lit(category(rule.rule_type))} AS category, {_lit(rule.severity)} AS severity"
    return f"CASE WHEN {' AND '.join(gates)} THEN transform({found}, x -> struct({names}, x.start AS start, x.`end` AS `end`, x.hit AS flagged, {_lit(rule.message)} AS message)) ELSE {EMPTY} END"


#: SQL: a text of English, or of a language that nobody told.
IN_ENGLISH = "coalesce(lang, 'en') = 'en'"


def pattern_issues(sents: DataFrame, rules: tuple[Rule, ...] = RULES, block_type: str | None = None, parity: bool = False) -> DataFrame:
    """sents' columns and one issue a row. With a block_type column, checks keep to their blocks; without, prose only.

    Where sents has a column `lang`, rules about English keep to its sentences.
    """
    chosen = [r for r in rules if not (parity and r.status != "live") and not (r.blocks and not block_type)]
    guarded = "lang" in sents.columns
    parts = []
    for r in chosen:
        tests = [f"{block_type} IN ({', '.join(map(_lit, r.blocks))})"] * bool(r.blocks) + [IN_ENGLISH] * (guarded and english(r))
        tests += [t] if (t := gates.gate(r, "sentence", "_lower", _lit)) else []
        found = issues_of(r, "sentence")
        parts.append(f"CASE WHEN {' AND '.join(tests)} THEN {found} ELSE {EMPTY} END" if tests else found)
    if not parts:
        raise ValueError("no rule applies")
    lowered = sents.select(*sents.columns, F.lower("sentence").alias("_lower"))
    return lowered.select(*sents.columns, F.explode(F.expr(f"concat({', '.join(parts)})")).alias("issue")).select(*sents.columns, "issue.*")


#: Words of a sentence whose lengths are summed up together.
PIECE = 32


def _openings(lex: DataFrame) -> str:
    """SQL, of a word w at place i of _all: whether a term of the lexicon may begin there, by its first two words."""
    terms = [(r["_n"], r["_first"], r["_second"]) for r in lex.select("_n", "_first", "_second").distinct().collect() if r["_first"] is not None]
    listed = lambda found: ", ".join(map(_lit, sorted(found)))
    tests = [f"lower(w) IN ({listed(alone)})"] if (alone := {f for n, f, _ in terms if n == 1}) else []
    if pairs := {f"{first} {second}" for n, first, second in terms if n > 1}:
        tests.append(f"lower(w) IN ({listed({f for n, f, _ in terms if n > 1})}) AND concat(lower(w), ' ', lower(get(_all, i + 1))) IN ({listed(pairs)})")
    return " OR ".join(f"({t})" for t in tests) or "false"


def lexicon_issues(sents: DataFrame, lexicon: DataFrame, fixed: bool = True) -> DataFrame:
    """sents' columns with rule_name, category, severity, pos (of the first word), start, end, flagged and replacement.

    Each word meets the terms that open with it, and the terms' other words are compared on those few rows alone. A fixed
    lexicon is small: its openings are known when the query is built, and only words that open a term become rows. A term
    is flagged where its words follow each other, whatever stands between them; the flagged text has them spaced.
    """
    cat = F.when(F.col("rule_type").contains("word_usage"), "word-usage").otherwise("style")
    term = F.split(F.lower("term"), " ")
    lex = lexicon.select(F.col("rule_type").alias("rule_name"), cat.alias("category"), "severity", "replacement", "case_sensitive", F.lower("term").alias("_term"), F.col("term").alias("_exact"), F.size(term).alias("_n"), F.element_at(term, 1).alias("_first"), F.get(term, F.lit(1)).alias("_second"))
    opens = _openings(lex) if fixed else "true"
    placed = sents.withColumn("_all", T.words("sentence")).withColumn("_at", F.expr(f"filter(transform(_all, (w, i) -> CASE WHEN {opens} THEN i END), x -> x IS NOT NULL)"))
    # The lengths of words with the gaps before them, where there is any to look up, and their sums by piece: a very long sentence is not summed up for each word.
    gaps = F.slice(F.split("sentence", T.WORD, -1), F.lit(1), F.size("_all"))
    sizes = F.when(F.size("_at") > 0, F.zip_with(gaps, "_all", lambda g, w: F.length(g) + F.length(w)))
    placed = placed.withColumn("_sizes", sizes).withColumn("_longest", lex.agg(F.coalesce(F.max("_n"), F.lit(0))).scalar())
    total = lambda array, begin, n: F.aggregate(F.slice(array, begin + 1, n), F.lit(0), lambda a, x: a + x)
    last = F.floor((F.greatest(F.size("_all"), F.lit(1)) - 1) / PIECE).cast("int")
    bases = F.when(F.size("_at") > 0, F.transform(F.sequence(F.lit(0), last), lambda k: total("_sizes", F.lit(0), k * PIECE)))
    # A word's row carries no more of its sentence than the longest term may take.
    piece = lambda i: F.floor(i / PIECE).cast("int")
    word = lambda i: F.struct(i.alias("pos"), (F.get("_bases", piece(i)) + total("_sizes", piece(i) * PIECE, i % PIECE + 1)).alias("until"), F.slice("_all", i + 1, F.col("_longest")).alias("w"), F.slice("_sizes", i + 1, F.col("_longest")).alias("l"))
    each = placed.withColumn("_bases", bases).select(*sents.columns, F.explode(F.transform("_at", word)).alias("_p")).withColumn("_word", F.element_at("_p.w", 1))
    joined = each.join(F.broadcast(lex) if fixed else lex, F.lower("_word") == F.col("_first"))
    flagged = joined.withColumn("flagged", F.array_join(F.slice("_p.w", F.lit(1), F.col("_n")), " "))
    found = flagged.where("lower(flagged) = _term AND (NOT case_sensitive OR flagged = _exact)")
    spans = found.withColumn("pos", F.col("_p.pos")).withColumn("start", F.col("_p.until") - F.length("_word")).withColumn("end", F.col("_p.until") + total("_p.l", F.lit(1), F.col("_n") - 1))
    return spans.select(*sents.columns, "pos", "start", "end", "flagged", "rule_name", "category", "severity", "replacement")


def excepted(issues: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Issues whose flagged text is not excepted for all rules (*) or for their own."""
    each = exceptions.select(F.lower("term").alias("_t"), F.col("rule_type").alias("_r"))
    return issues.join(each, (F.lower("flagged") == F.col("_t")) & ((F.col("_r") == "*") | (F.col("_r") == F.col("rule_name"))), "left_anti")


#: Characters of a bin in which finds meet ranges.
BIN = 64


def outside(issues: DataFrame, ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Issues that lie in no protected range (keys, r_start, r_end) of theirs; they meet the ranges over the bin they begin in."""
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("r_start") / BIN), F.floor(F.col("r_end") / BIN))))
    cond = F.floor(F.col("i.start") / BIN) == F.col("r._bin")
    for k in keys:
        cond = cond & (F.col(f"i.{k}") == F.col(f"r.{k}"))
    return issues.alias("i").join(binned.alias("r"), cond & (F.col("r.r_start") <= F.col("i.start")) & (F.col("i.end") <= F.col("r.r_end")), "left_anti")


def technical(c: str) -> Column:
    """URL, e-mail address, path, code, camelCase, snake_case or dotted name."""
    return F.col(c).rlike("https?://|[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.|(?:^| )/[a-z]+/|`|[a-z][A-Z][a-z]|[a-z]_[a-z]|[a-z]\\.[a-z]+\\(")


def applicable(blocks: DataFrame, block_rules: DataFrame, exclusions: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """(doc_id, block_idx, rule_type): the rules of each block's type; a type without rules takes the paragraph's."""
    known = block_rules.select("block_type").distinct().withColumn("known", F.lit(True))
    prose = blocks.where(~F.col("block_type").isin(*skip)).join(F.broadcast(known), "block_type", "left")
    routed = prose.withColumn("as_type", F.when(F.col("known"), F.col("block_type")).otherwise("paragraph"))
    rules = routed.join(F.broadcast(block_rules.withColumnRenamed("block_type", "as_type")), "as_type")
    return rules.join(F.broadcast(exclusions), ["block_type", "rule_type"], "left_anti").select("doc_id", "block_idx", "rule_type")
