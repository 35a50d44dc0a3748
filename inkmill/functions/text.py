"""Text primitives as column expressions: normalising, sentences, words, syllables and spans of pattern finds.

Patterns keep to what Java and RE2 read alike: no word boundaries, look-arounds or back references in shared ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}]+(?:['’-][\\p{L}\\p{N}]+)*"
SPAN = "array<struct<start: int, end: int, hit: string>>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """As Python's strip for space, tab and line ends."""
    return F.trim(col(c), F.lit(" \t\r\n"))


def normalize_whitespace(c: str | Column) -> Column:
    """CRLF to LF, tab to space, runs of spaces to one; line ends stay."""
    return F.regexp_replace(F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" ")), " {2,}", " ")


def collapse(c: str | Column) -> Column:
    return F.regexp_replace(strip(c), "[ \\t\\r\\n]+", " ")


def normalize(c: str | Column) -> Column:
    """Comparison form: stripped and lower-cased."""
    return F.lower(strip(c))


def sanitize(c: str | Column) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(col(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def sentence_array(c: str | Column) -> Column:
    """Sentences end at a mark followed by white space, or at a line end; pieces may be blank."""
    return F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), "([.!?])[ \\t\\r\\n]+", "$1\n"), "\\n+")


def sentences(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, sent_idx, sentence) without blank ones; numbered before blank ones go."""
    split = docs.select(*keys, F.posexplode(sentence_array(text)).alias("sent_idx", "piece"))
    return split.select(*keys, "sent_idx", strip("piece").alias("sentence")).where("sentence <> ''")


def words(c: str | Column) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(WORD), F.lit(0))


def tokens(sents: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    return sents.select(*keys, F.posexplode(words("sentence")).alias("pos", "token")).withColumn("lower", F.lower("token"))


def syllables(w: Column) -> Column:
    """Vowel groups, less a silent e, es or ed at the end; 1 at least."""
    lower = F.lower(w)
    groups = F.size(F.regexp_extract_all(lower, F.lit("[aeiouy]+"), F.lit(0)))
    silent = F.when(lower.rlike("[^aeiouyl](?:e|es|ed)$"), 1).otherwise(0)
    return F.greatest(F.lit(1), groups - silent)


def finds(c: str | Column, pattern: str) -> Column:
    """Every find of a pattern with its span in code points, end exclusive; the pattern never matches empty text."""
    text, p = col(c), F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    found = F.aggregate(F.slice(pairs, F.lit(1), F.size(hits)), start, step)["out"]
    return F.when(F.regexp_like(text, p), found).otherwise(F.array().cast(SPAN))


def finds_sql(text: str, literal: str) -> str:
    """As `finds`, in SQL text, for a text known to have a find; literal: the pattern as a SQL string."""
    step = "(a, x) -> struct(a.at + length(x.`0`) + length(x.`1`) AS at, concat(a.out, array(struct(a.at + length(x.`0`) AS start, a.at + length(x.`0`) + length(x.`1`) AS `end`, x.`1` AS hit))) AS out)"
    hits = f"regexp_extract_all({text}, {literal}, 0)"
    return f"aggregate(slice(arrays_zip(split({text}, {literal}, -1), {hits}), 1, size({hits})), struct(0 AS at, cast(array() AS {SPAN}) AS out), {step}, a -> a.out)"


def before(text: Column, at: Column) -> Column:
    """The character before a 0-based position, or ''."""
    return F.when(at > 0, F.substring(text, at, F.lit(1))).otherwise("")


def utf16_to_code_point(text: Column, offset: Column) -> Column:
    """A code-point offset for one in UTF-16 units."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-16LE"), F.lit(1), 2 * offset), "UTF-16LE"))
