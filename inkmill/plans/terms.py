"""Word lists over prose that Spark makes of the documents: each word stands for an entry of a vocabulary full of terms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicons, terms
from . import duck

LEXICON = lexicons.inflected(lexicons.rows())
EXCEPTIONS = (("*", "native"), ("*", "master"), ("word_usage_k", "kill"), ("do_not_use", "of course"), ("simple_words", "objectives"), ("simple_words", "due to"))
PROTECTED = ("Kill Switch", "Leverage Cloud Server", "Log In To Go", "Easy Access", "Implement")
FILLERS = ("the", "agent", "node", "a", "of", "to", "in", "tool", "and")
#: Terms of plain words, each once, then names and fillers; every word of a document stands for one.
VOCABULARY = [*dict.fromkeys(r[1] for r in LEXICON if re.fullmatch("[A-Za-z]+(?:[ -][A-Za-z]+)*", r[1])), *[n for n in PROTECTED for _ in range(20)], *FILLERS * 10]


def termed_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_idx, sentence): documents' sentences, word by word by first letter, length and place; every fifth entry has a capital."""
    sents = T.sentences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = F.array(*[F.lit(v) for v in VOCABULARY])

    def entry(w, i):
        chosen = F.element_at(listed, F.pmod(F.ascii(w) * 31 + F.length(w) * 7 + i * i * 13, F.lit(len(VOCABULARY))).cast("int") + 1)
        return F.when(i % 5 == 0, F.concat(F.upper(F.substring(chosen, 1, 1)), F.substring(chosen, F.lit(2), F.length(chosen)))).otherwise(chosen)

    return sents.select("doc_id", "sent_idx", F.array_join(F.transform(T.words("sentence"), entry), " ").alias("sentence"))


def guarded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in any inflection, the longest first, without exceptions and protected names, with replacements in case."""
    lexicon = spark.createDataFrame(LEXICON, lexicons.SCHEMA)
    exceptions, protected = spark.createDataFrame(EXCEPTIONS, "rule_type string, term string"), spark.createDataFrame([(p,) for p in PROTECTED], "term string")
    return terms.guarded(termed_prose(spark, sf_dir), lexicon, exceptions, protected)


def _alternation(texts: list[str]) -> str:
    """A pattern that takes the longest of the texts first, between spaces of their own."""
    return "(?i) (?:" + "|".join(t.replace(" ", "  ") for t in sorted(set(texts), key=lambda t: (-len(t), t))) + ") "


def _found(texts: list[str], label: str) -> str:
    """Finds of one pattern over the doubled spaces, back in places of the sentence."""
    return f"""SELECT {label} AS rule_name, doc_id, sent_idx, greatest(length(replace(left(doubled, start_), '  ', ' ')) - 1, 0) AS start, replace(trim(hit), '  ', ' ') AS flagged
FROM ({duck.finds('prose', 'doc_id, sent_idx', 'doubled', _alternation(texts))})"""


def _sql() -> str:
    rules: dict[str, dict[str, tuple]] = {}
    for rule, term, replacement, severity, _ in LEXICON:
        rules.setdefault(rule, {}).setdefault(term.lower(), []).append((replacement, severity))
    plain = {r: {t: min(v) for t, v in ts.items() if re.fullmatch("[a-z]+(?:[ -][a-z]+)*", t)} for r, ts in rules.items()}
    each = "\nUNION ALL ".join(_found(list(ts), duck.lit(r)) for r, ts in plain.items() if ts)
    values = lambda rows: ", ".join("(" + ", ".join(map(duck.lit, r)) + ")" for r in rows)
    return f"""WITH {duck.TOKENS},
vocabulary AS (SELECT [{', '.join(map(duck.lit, VOCABULARY))}] AS v),
e AS (SELECT doc_id, sent_idx, pos, v[(unicode(token) * 31 + length(token) * 7 + pos * pos * 13) % {len(VOCABULARY)} + 1] AS word FROM tokens, vocabulary),
prose AS (SELECT doc_id, sent_idx, ' ' || replace(string_agg(CASE WHEN pos % 5 = 0 THEN upper(word[1]) || word[2:] ELSE word END, ' ' ORDER BY pos), ' ', '  ') || ' ' AS doubled FROM e GROUP BY ALL),
lexicon AS (SELECT * FROM (VALUES {values([(r, t, *v) for r, ts in plain.items() for t, v in ts.items()])}) AS v(rule_name, term, replacement, severity)),
found AS ({each}),
held AS ({_found(list(PROTECTED), "'protected'")}),
excepted AS (SELECT * FROM (VALUES {values(EXCEPTIONS)}) AS v(rule_type, term))
SELECT f.doc_id, f.sent_idx, f.rule_name, l.severity, f.start::INTEGER AS start, (f.start + length(flagged))::INTEGER AS "end", flagged, CASE WHEN flagged[1] <> lower(flagged[1]) THEN upper(l.replacement[1]) || l.replacement[2:] ELSE l.replacement END AS replacement
FROM found AS f JOIN lexicon AS l ON l.rule_name = f.rule_name AND l.term = lower(flagged)
WHERE NOT EXISTS (FROM excepted AS x WHERE x.term = lower(f.flagged) AND x.rule_type IN ('*', f.rule_name))
AND NOT EXISTS (FROM held AS h WHERE h.doc_id = f.doc_id AND h.sent_idx = f.sent_idx AND h.start <= f.start AND f.start + length(f.flagged) <= h.start + length(h.flagged))"""


def queries() -> dict:
    return {"guarded_terms": guarded_terms}


def oracle_sql() -> dict[str, str]:
    return {"guarded_terms": _sql()}
