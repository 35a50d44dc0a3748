"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are runs of characters other than space and U+0009 to U+000D. The base measures follow the query's contract; the
further rules compare ratios with the table below. A null or empty text has no words and fails the base; every row is
kept with its measures, repeated rows and ties alike; a row's other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"

#: Function words of the corpus' languages; a text of some length without any of them is a list or noise.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "der", "die", "und", "von", "den", "des", "le", "la", "de", "les", "et", "que", "el", "los", "en", "y")


@dataclass(frozen=True)
class Rule:
    """A row is rejected where `measure` is below `low` or above `high`, among rows of at least `from_words` words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


# Measures: SQL expressions over the base measures and n_chars, n_lines, n_stop, n_upper.
RULES = (
    Rule("many words", "n_words", high=1_000_000),
    Rule("mean word length", "word_chars / nullif(n_words, 0)", low=2.0, high=15.0, from_words=1),
    Rule("symbols a word", "n_symbols / nullif(n_words, 0)", high=0.3, from_words=1),
    Rule("repeated lines", "n_dup_lines / nullif(n_lines, 0)", high=0.5, from_words=50),
    Rule("stop words", "n_stop / nullif(n_words, 0)", low=0.005, from_words=50),
    Rule("capital letters", "n_upper / nullif(word_chars, 0)", high=0.5, from_words=50),
)


def measures(text: Column) -> dict[str, Column]:
    """Named stages, each over the names of the one before; see `score`."""
    return {
        "_words": common.words_of(text),
        "_lines": F.filter(F.split(text, "\n"), lambda line: F.translate(line, common.BLANKS, "") != ""),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "word_chars": F.length(F.translate(text, common.BLANKS, "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "[^A-ZÀ-ÖØ-Þ]", "")).cast("long"),
    }


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs' columns packed in `row`, with the measures, base_failed, failed (names of the rules) and kept."""
    text = common.text_of(text_col)
    first = docs.select(common.packed(docs).alias("row"), *[c.alias(n) for n, c in measures(text).items()])
    counted = first.select(
        "row",
        "n_symbols",
        "word_chars",
        "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.expr("CASE WHEN size(_words) >= 3 THEN transform(sequence(0, size(_words) - 3), i -> concat_ws(' ', _words[i], _words[i + 1], _words[i + 2])) ELSE cast(array() AS array<string>) END").alias("_windows"),
    )
    # Windows are compared by their exact words: sorted with their places, equal ones are neighbours (n log n).
    # Only a text with some window twice needs its windows sorted with their places.
    sorted_ = F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (w, i) -> struct(w, i))) ELSE cast(array() AS array<struct<w: string, i: int>>) END")
    placed = counted.withColumn("_sorted", sorted_).drop("_windows")
    twice = F.expr("transform(filter(transform(_sorted, (x, k) -> struct(x.i AS i, (k > 0 AND _sorted[greatest(k - 1, 0)].w = x.w) OR (k + 1 < size(_sorted) AND _sorted[least(k + 1, size(_sorted) - 1)].w = x.w) AS twice)), x -> x.twice), x -> x.i)")
    covered = placed.withColumn("_twice", twice).drop("_sorted")
    repeats = F.size(F.array_distinct(F.concat("_twice", F.transform("_twice", lambda i: i + 1), F.transform("_twice", lambda i: i + 2))))
    base = covered.withColumn("n_repeat_words", repeats.cast("long")).drop("_twice")
    base = base.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    tests = []
    for r in rules:
        bounds = [t for t in (f"{r.measure} < {r.low}" if r.low is not None else "", f"{r.measure} > {r.high}" if r.high is not None else "") if t]
        tests.append(F.expr(f"CASE WHEN n_words >= {r.from_words} AND ({' OR '.join(bounds)}) THEN '{r.name}' END"))
    judged = base.withColumn("failed", F.array_compact(F.array(*tests)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(common.table(spark, sf_dir, "documents"))
    return scored.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        ratio = r.measure.replace(" / ", "::DOUBLE / ")
        bounds = " OR ".join(([f"{ratio} < {r.low}"] if r.low is not None else []) + ([f"{ratio} > {r.high}"] if r.high is not None else []))
        tests.append(f"(n_words >= {r.from_words} AND ({bounds}))")
    return f"""
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
    s AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
    w AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM s WHERE len(words) >= 3),
    g AS (SELECT k, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS tri FROM w),
    d AS (SELECT k, i, count(*) OVER (PARTITION BY k, tri) AS c FROM g),
    r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM d WHERE c > 1) GROUP BY k),
    m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
                 coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(words, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop,
                 length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_upper
          FROM s LEFT JOIN r USING (k)),
    b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept FROM b
    """


SQL = {"op10_quality_rules": _sql()}
