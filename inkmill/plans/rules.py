"""Queries of the rule operators: one for each pattern rule and each lexicon rule, over documents and pages.

Each runs over whole tables and the rules' own specimens (negative ids), so that rules whose words the corpus lacks
show both what they flag and what their guards leave alone.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicons
from ..operators.rule_table import RULE_TYPES, RULES, Rule, category, english
from ..operators.rules import IN_ENGLISH, lexicon_issues, pattern_issues
from ..sources import html
from . import duck, fixtures

SPECIMENS = [(-1 - k, s) for k, s in enumerate(s for r in RULES if not r.blocks for s in (r.yes, r.no))]
BLOCK_SPECIMENS = [(-1 - k, 0, b, 0, s) for k, (b, s) in enumerate((r.blocks[0], s) for r in RULES if r.blocks for s in (r.yes, r.no))] + fixtures.structure_rows()
PROSE_SPECIMENS = list(fixtures.PROSE.items())
OUT = ("doc_id", "sent_idx", "check", "start", "end", "flagged", "severity")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return docs.unionByName(spark.createDataFrame(SPECIMENS, "doc_id long, text string").withColumn("lang", F.lit("en")))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return docs.unionByName(spark.createDataFrame(PROSE_SPECIMENS, "doc_id long, text string").withColumn("lang", F.lit("en")))


#: The review profile: the rules whose finds are scored, merged and reported on.
PROFILE = ("abbreviations", "accessibility", "capitalization", "contractions", "ellipses", "exclamation_points", "numbers_general", "punctuation_and_symbols", "quotation_marks", "second_person", "semicolons", "slashes", "spacing", "tone")


def profile_issues(sents: DataFrame, guarded: bool = True) -> DataFrame:
    """(doc_id, sent_idx, rule_name, category, severity, start_pos, end_pos, flagged): finds of the profile's rules and of all word lists.

    Unguarded, rules and lists about English run on texts of every language.
    """
    keys = sents.select("doc_id", *["lang"] * guarded, "sent_idx", "sentence")
    by_pattern = pattern_issues(keys, tuple(r for r in RULES if r.rule_type in PROFILE and not r.blocks))
    by_term = lexicon_issues(keys.where(IN_ENGLISH) if guarded else keys, lexicons.builtin(sents.sparkSession))
    names = ("doc_id", "sent_idx", "rule_name", "category", "severity", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "flagged")
    return by_pattern.select(*names).unionByName(by_term.select(*names)).distinct()


def profile_issues_sql(guarded: bool = True) -> str:
    """As profile_issues, from sentences and w0."""
    each = [f"SELECT doc_id, sent_idx, {duck.lit(r.rule_type)} AS rule_name, {duck.lit(category(r.rule_type))} AS category, severity, start AS start_pos, \"end\" AS end_pos, flagged FROM ({check_sql(r, guarded)})" for r in RULES if r.rule_type in PROFILE and not r.blocks]
    lex = [r[:4] for r in lexicons.rows()]
    terms = f"SELECT doc_id, sent_idx, rule_type, CASE WHEN contains(rule_type, 'word_usage') THEN 'word-usage' ELSE 'style' END, severity, start, \"end\", flagged FROM ({lexicon_sql(lex, guarded)})"
    return "\nUNION\n".join([*each, terms])


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentences(corpus(spark, sf_dir), keys=("doc_id", "lang"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(BLOCK_SPECIMENS, "doc_id long, block_idx int, block_type string, level int, content string")
    return html.blocks(spark.read.parquet(f"{sf_dir}/pages.parquet")).unionByName(own)


def rule(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = tuple(r for r in RULES if r.rule_type == name)
    prose, block = tuple(r for r in chosen if not r.blocks), tuple(r for r in chosen if r.blocks)
    parts = []
    if prose:
        parts.append(pattern_issues(sentences(spark, sf_dir), prose).select(*OUT))
    if block:
        there = blocks(spark, sf_dir).select("doc_id", F.col("block_idx").alias("sent_idx"), "block_type", F.col("content").alias("sentence"))
        parts.append(pattern_issues(there, block, "block_type").select(*OUT))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prose check in one pass: issues by rule, check and severity."""
    found = pattern_issues(sentences(spark, sf_dir))
    return found.groupBy("rule_name", "check", "category", "severity").agg(F.count("*").alias("n_issues"), F.sum("start").alias("sum_start"))


def word_list(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexicons.builtin(spark).where(F.col("rule_type") == name)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(IN_ENGLISH).select("doc_id", "text")
    own = spark.createDataFrame(_term_specimens(name), "doc_id long, text string")
    return lexicon_issues(T.sentences(docs.unionByName(own)), lex).select("doc_id", "sent_idx", "pos", "start", "end", "flagged", "replacement", "severity")


def all_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word list in one scan of documents: finds by rule and term."""
    found = lexicon_issues(T.sentences(prose(spark, sf_dir).where(IN_ENGLISH)), lexicons.builtin(spark))
    return found.groupBy("rule_name", F.lower("flagged").alias("term"), "severity").agg(F.count("*").alias("n_issues"), F.countDistinct("doc_id").alias("n_docs"), F.sum("start").alias("sum_start"))


def _term_specimens(name: str) -> list[tuple]:
    return [(-1 - k, f"Now {r[1]} it.") for k, r in enumerate(x for x in lexicons.rows() if x[0] == name)]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: duck.lit(v) if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names}))"


CORPUS_SQL = f"(SELECT doc_id, lang, text FROM documents UNION ALL SELECT doc_id::BIGINT, 'en', text FROM {_values(SPECIMENS, 'doc_id, text')})"
SENTENCES_SQL = duck.SENTENCES.replace("FROM documents", f"FROM {CORPUS_SQL}")
PROSE_SQL = f"(SELECT doc_id, lang, text FROM documents UNION ALL SELECT doc_id::BIGINT, 'en', text FROM {_values(PROSE_SPECIMENS, 'doc_id, text')})"
BLOCKS_SQL = f"{duck.blocks()},\nblocks AS (SELECT doc_id, block_idx, block_type, level, content FROM html_blocks UNION ALL SELECT doc_id::BIGINT, block_idx::INTEGER, block_type, level::INTEGER, content FROM {_values(BLOCK_SPECIMENS, 'doc_id, block_idx, block_type, level, content')})"


def check_sql(r: Rule, guarded: bool = True) -> str:
    """SELECT of one check from sentences, or from block_sentences."""
    source = "sentences" if not r.blocks else f"(SELECT * FROM block_sentences WHERE block_type IN ({', '.join(duck.lit(b) for b in r.blocks)}))"
    gates = (["coalesce(lang, 'en') = 'en'"] if guarded and english(r) and not r.blocks else []) + ([f"regexp_matches(sentence, {duck.lit(r.has)})"] if r.has else []) + ([f"NOT regexp_matches(sentence, {duck.lit(r.lacks)})"] if r.lacks else [])
    if gates:
        source = f"(SELECT * FROM {source} WHERE {' AND '.join(gates)})"
    left, right = "CASE WHEN start_ > 0 THEN substr(sentence, start_, 1) ELSE '' END", "substr(sentence, end_ + 1, 1)"
    tests = ["true"]
    for on, side in ((r.word, left), (r.word, right)):
        if on:
            tests.append(f"NOT regexp_matches({side}, '[\\p{{L}}\\p{{N}}_]')")
    for signs, side in ((r.before, left), (r.after, right)):
        if signs:
            tests.append(f"NOT regexp_matches({side}, {duck.lit(f'[{signs}]')})")
    for texts, no in ((r.only, ""), (r.never, "NOT ")):
        if texts:
            tests.append(f"lower(hit) {no}IN ({', '.join(map(duck.lit, texts))})")
    return f"SELECT doc_id, sent_idx, {duck.lit(r.check)} AS \"check\", start_ AS start, end_ AS \"end\", hit AS flagged, {duck.lit(r.severity)} AS severity FROM ({duck.finds(source, 'doc_id, sent_idx', 'sentence', r.pattern)}) WHERE {' AND '.join(tests)}"


def rule_sql(name: str) -> str:
    chosen = [r for r in RULES if r.rule_type == name]
    head = ([SENTENCES_SQL] if any(not r.blocks for r in chosen) else []) + ([f"{BLOCKS_SQL},\nblock_sentences AS (SELECT doc_id, block_idx AS sent_idx, block_type, content AS sentence FROM blocks)"] if any(r.blocks for r in chosen) else [])
    return f"WITH {', '.join(head)}\n" + "\nUNION ALL\n".join(check_sql(r) for r in chosen)


def all_rules_sql() -> str:
    each = [f"SELECT {duck.lit(r.rule_type)} AS rule_name, {duck.lit(r.check)} AS \"check\", {duck.lit(category(r.rule_type))} AS category, severity, start FROM ({check_sql(r)})" for r in RULES if not r.blocks]
    return f"WITH {SENTENCES_SQL} SELECT rule_name, \"check\", category, severity, count(*) AS n_issues, sum(start)::BIGINT AS sum_start FROM ({' UNION ALL '.join(each)}) GROUP BY ALL"


def lexicon_sql(lex: list[tuple], guarded: bool = True) -> str:
    """SELECT of the finds of a lexicon (rule_type, term, replacement, severity) from w0: runs of words by their length and text."""
    longest = max(len(r[1].split(" ")) for r in lex)
    sizes = lambda array, n: f"coalesce(list_sum(list_transform({array}[1:{n}], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, sent_idx, (p - 1)::INTEGER AS pos, ({sizes('gaps', 'p')} + {sizes('words', 'p - 1')})::INTEGER AS start, ({sizes('gaps', 'p + n - 1')} + {sizes('words', 'p + n - 1')})::INTEGER AS "end", flagged, rule_type, replacement, severity FROM
      (SELECT r.*, l.*, string_split_regex(sentence, '{duck.WORD}') AS gaps FROM
        (SELECT doc_id, sent_idx, sentence, words, p, n, array_to_string(words[p:p + n - 1], ' ') AS flagged FROM
          (SELECT doc_id, sent_idx, sentence, words, p, unnest(range(1, least({longest}, len(words) - p + 1) + 1)) AS n FROM
            (SELECT doc_id, sent_idx, sentence, words, unnest(range(1, len(words) + 1)) AS p FROM w0{" WHERE coalesce(lang, 'en') = 'en'" * guarded}))) AS r
        JOIN {_values(lex, 'rule_type, term, replacement, severity')} AS l ON lower(r.flagged) = l.term)"""


def word_list_sql(name: str) -> str:
    lex = [r[:4] for r in lexicons.rows() if r[0] == name]
    docs = f"(SELECT doc_id, lang, text FROM documents UNION ALL SELECT doc_id::BIGINT, 'en', text FROM {_values(_term_specimens(name), 'doc_id, text')})"
    return f"""WITH {duck.TOKENS.replace('FROM documents', f'FROM {docs}')}
    SELECT doc_id, sent_idx, pos, start, "end", flagged, replacement, severity FROM ({lexicon_sql(lex)})"""


def all_word_lists_sql() -> str:
    lex = [r[:4] for r in lexicons.rows()]
    return f"""WITH {duck.TOKENS.replace('FROM documents', f'FROM {PROSE_SQL}')} SELECT rule_type AS rule_name, lower(flagged) AS term, severity, count(*) AS n_issues, count(DISTINCT doc_id) AS n_docs, sum(start)::BIGINT AS sum_start
    FROM ({lexicon_sql(lex)}) GROUP BY ALL"""


WORD_LISTS = tuple(dict.fromkeys(r[0] for r in lexicons.rows()))


def queries() -> dict:
    found = {f"rule_{n}": partial(rule, n) for n in RULE_TYPES}
    found |= {f"words_{n}": partial(word_list, n) for n in WORD_LISTS}
    return found | {"all_pattern_rules": all_rules, "all_word_lists": all_word_lists}


def oracle_sql() -> dict[str, str]:
    found = {f"rule_{n}": rule_sql(n) for n in RULE_TYPES}
    found |= {f"words_{n}": word_list_sql(n) for n in WORD_LISTS}
    return found | {"all_pattern_rules": all_rules_sql(), "all_word_lists": all_word_lists_sql()}
