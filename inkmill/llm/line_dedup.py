"""Line dedup by an exact set-similarity join, in DataFrame and SQL functions only.

A line's set is that of its words (runs of characters other than space and U+0009 to U+000D). A line is removed if an
earlier one, in the order of doc_id and then of lines, has a Jaccard similarity of 0.8 or more with it, whether or not
that one is itself removed. Blank lines are neither compared nor removed.

1. Equal lines collapse to their first place (keys: two 64-bit hashes of the line).
2. Words are ordered by rarity. The order comes from a sketch of SKETCH counts over all distinct lines, a table of fixed
   size: a word's class is that of its slot's count, ties go by the word's hash. Any total order gives exact results;
   this one makes prefixes selective.
3. Prefix filter: sets within the threshold share a word among their first n - ceil(0.8 n) + 1. Lines meet on those
   words, with the length filter, the positional filter, and a parity filter: a line's words flip bits of a 128-bit
   number, and two lines' numbers differ in no more bits than the lines have words apart.
4. First each line meets only its words' hubs (the word's most copied line): a large group of near copies settles in
   as many meetings as it has lines. Then the lines that are not settled meet the earlier lines of all their words.
   Both run in passes over shares of the words, so that only a share of the index lies on disk at a time.
5. The pairs left are verified on the lines' own words, and the later line of each is removed.

The joins' rows are index entries, never all pairs of a group: equal lines, however many, are one entry, hubs settle
near copies, and Spark splits the lists of frequent words as skewed partitions of the join.

Null and empty texts have no lines and stay as they are; ids may be null (they come first) and repeated (repeated rows
follow each other by file and place); an empty table gives no rows; other columns come back unchanged, whatever their
names. Rows are known by common.numbered, which holds however a later read is split into tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Jaccard threshold as a fraction.
UP, DOWN = 4, 5
#: Slots of the sketch, a power of two, and how many of them the driver gets in a row.
SKETCH, BLOCK = 1 << 18, 1024
#: Rarity classes: so many for each doubling of a slot's count, and below 128 in all.
CLASSES = 3
#: The index is dealt by word in so many passes, each of which has its share on disk alone.
PASSES = 2
#: Lines of so many pairs at most are picked by a broadcast of their ids.
BROADCAST_PAIRS = 1_000_000


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.numbered(docs, {"i": F.col(id_col).cast("long"), "t": common.text_of(text_col), "row": common.packed(docs)})


NOT_BLANK = "[^\\x20\\x09-\\x0D]"
#: Blanks within a line that are no spaces.
OTHERS = common.BLANKS.replace(" ", "").replace("\n", "")


def _plain_lines(text: str) -> Column:
    """A text's lines with spaces for other blanks, which changes no line's words: a text is searched for those once, not each of its lines."""
    return F.split(F.when(F.col(text).rlike("[\\x09\\x0B-\\x0D]"), F.translate(text, OTHERS, " " * len(OTHERS))).otherwise(F.col(text)), "\n")


def _lines(numbered: DataFrame) -> DataFrame:
    return numbered.select("k", "i", F.posexplode(_plain_lines("t")).alias("n", "line")).where(F.ltrim("line") != "")


def _words(line: str) -> Column:
    """The words of one of _plain_lines; some may be empty."""
    return F.split(line, " ")


def sketch(reps: DataFrame) -> list[int]:
    """A rarity class for each of SKETCH slots, from all words of all distinct lines: so many for each doubling of the count."""
    slots = reps.select(F.explode(_words("line")).alias("w")).where("w <> ''").select(F.xxhash64("w").bitwiseAND(F.lit(SKETCH - 1)).alias("slot"))
    rarity = F.least(F.lit(127), F.floor(CLASSES * F.log2(F.count("*") + 1)))
    # A row for the driver for each BLOCK slots, with their classes: the table's size is fixed.
    pair = F.concat_ws(":", F.col("slot").cast("string"), F.col("class").cast("string"))
    rows = slots.groupBy("slot").agg(rarity.cast("int").alias("class")).groupBy(F.expr(f"slot div {BLOCK}")).agg(F.array_join(F.collect_list(pair), ",").alias("pairs"))
    classes = [1] * SKETCH
    for r in rows.collect():
        for slot, rare in (x.split(":") for x in r.pairs.split(",")):
            classes[int(slot)] = int(rare)
    return classes


def keys(reps: DataFrame, classes: list[int]) -> DataFrame:
    """(id, copies, doc, n, up, low, prefix): distinct words of each line, their parities, and the keys of its prefix.

    A key has a word's class in the upper bits and 56 bits of its hash below.
    """
    table = f"cast(split('{','.join(map(str, classes))}', ',') AS array<tinyint>)"
    hashes = F.transform(F.array_remove(_words("line"), ""), lambda w: F.xxhash64(w)).alias("h")
    # Never null, which lets Spark sort plain numbers.
    key = f"transform(h, x -> coalesce(shiftleft(cast({table}[x & {SKETCH - 1}] AS bigint), 56), 0L) | (x & {(1 << 56) - 1}L))"
    sets = reps.select("id", "copies", F.coalesce("place.i", F.lit(-(2**63))).alias("doc"), hashes).select("id", "copies", "doc", F.array_distinct(F.expr(key)).alias("h"))
    # Bits 55 to 49 of a key: one of 128 bits, the upper and the lower half by itself (a shift takes a number's last 6 bits).
    upper, lower = (f"aggregate(h, 0L, (a, x) -> CASE WHEN (x & {1 << 55}L) {side} 0 THEN a ^ shiftleft(1L, cast(shiftright(x, 49) AS int)) ELSE a END)" for side in ("<>", "="))
    ordered = sets.select("id", "copies", "doc", F.size("h").alias("n"), F.expr(upper).alias("up"), F.expr(lower).alias("low"), F.sort_array("h").alias("keys"))
    return ordered.select("id", "copies", "doc", "n", "up", "low", F.slice("keys", F.lit(1), F.expr(f"cast(n - (n * {UP} + {DOWN - 1}) div {DOWN} + 1 AS int)")).alias("prefix"))


def _index(keyed: DataFrame, of: int, *more: str) -> DataFrame:
    """Index entries of one pass' words."""
    entries = keyed.select("id", "n", "up", "low", *more, F.posexplode("prefix").alias("at", "word"))
    return entries.where(F.pmod(F.col("word"), F.lit(PASSES)) == of)


def _by_passes(spark: SparkSession, path: str, meet: Callable[[int], DataFrame]) -> DataFrame:
    """The pairs (x, y) of all passes; each is written, and its shuffle goes, before the next."""
    for of in range(PASSES):
        meet(of).distinct().write.parquet(f"{path}/{of}")
        common.release(spark)
    pairs = spark.read.schema("x long, y long").parquet(*[f"{path}/{of}" for of in range(PASSES)])
    return common.written(pairs.distinct(), f"{path}/all")


def _may_match(a: str, b: str) -> str:
    """SQL: the length, positional and parity filters for index entries a and b of one word."""
    need = f"(({UP} * ({a}.n + {b}.n) + {UP + DOWN - 1}) div {UP + DOWN})"
    return f"{a}.n * {UP} <= {b}.n * {DOWN} AND {b}.n * {UP} <= {a}.n * {DOWN} AND least({a}.n - {a}.at, {b}.n - {b}.at) >= {need} AND bit_count({a}.up ^ {b}.up) + bit_count({a}.low ^ {b}.low) <= {a}.n + {b}.n - 2 * {need}"


def _later(pairs: DataFrame, reps: DataFrame, path: str) -> DataFrame:
    """(id) of the later line of each pair (x, y) whose words are similar enough."""
    picked = reps.select("id", "place", "line")
    if pairs.count() <= BROADCAST_PAIRS:  # at most 16 MB of ids; beyond that the lines are shuffled by id instead
        picked = picked.join(F.broadcast(pairs.selectExpr("explode(array(x, y)) AS id").distinct()), "id", "left_semi")
    else:
        picked = picked.join(pairs.selectExpr("explode(array(x, y)) AS id").distinct(), "id", "left_semi")
    # First on 15-bit hashes: words that share one count once, so a set's loss of members is granted to the overlap.
    full = F.array_distinct(F.array_remove(_words("line"), ""))
    brief = F.array_distinct(F.transform("full", lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFF)).cast("smallint")))
    picked = common.written(picked.withColumn("full", full).select("id", "place", "line", F.size("full").alias("n"), brief.alias("s")), f"{path}/picked")
    x, y = (picked.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}")) for k in "xy")
    most = F.size(F.array_intersect("sx", "sy")) + F.col("nx") - F.size("sx")
    close = pairs.join(x, "x").join(y, "y").where((UP + DOWN) * most >= UP * (F.col("nx") + F.col("ny"))).select("x", "y")
    left = close.join(picked.select(F.col("id").alias("x"), F.col("place").alias("px"), F.col("line").alias("lx")), "x")
    both = left.join(picked.select(F.col("id").alias("y"), F.col("place").alias("py"), F.col("line").alias("ly")), "y")
    sx, sy = (F.array_distinct(F.array_remove(_words(c), "")) for c in ("lx", "ly"))
    shared = both.select("x", "y", "px", "py", F.size(F.array_intersect(sx, sy)).alias("c"), (F.size(sx) + F.size(sy)).alias("m"))
    return shared.where(f"{UP + DOWN} * c >= {UP} * m").select(F.when(F.col("px") < F.col("py"), F.col("y")).otherwise(F.col("x")).alias("id")).distinct()


def survivors(numbered: DataFrame, path: str) -> DataFrame:
    """(k, n): the places of the lines that stay."""
    spark = numbered.sparkSession
    lines = _lines(numbered).select(F.struct("i", "k", "n").alias("place"), "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    first = lines.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("line").alias("line"), F.count("*").alias("copies"))
    reps = common.written(first.select(F.monotonically_increasing_id().alias("id"), "place", "line", "copies"), f"{path}/lines")
    del lines, first
    common.release(spark)
    keyed = common.written(keys(reps, sketch(reps)), f"{path}/keys")

    def to_hubs(of: int) -> DataFrame:
        # The window holds a word's lines in rows that spill, and passes them on one by one.
        entry = _index(keyed, of, "copies").select("word", F.struct("copies", "id", "n", "at", "up", "low").alias("a"))
        met = entry.select("a", F.max("a").over(Window.partitionBy("word")).alias("b")).where(f"a.id <> b.id AND {_may_match('a', 'b')}")
        return met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))

    settled = common.written(_later(_by_passes(spark, f"{path}/hub-pairs", to_hubs), reps, f"{path}/hubs"), f"{path}/settled")

    flagged = keyed.join(settled.withColumn("settled", F.lit(True)), "id", "left").withColumn("due", F.when(F.col("settled"), F.lit(-(2**63))).otherwise(F.col("doc")))

    def to_earlier(of: int) -> DataFrame:
        index = _index(flagged, of, "doc", "due")
        # A settled line is due before any other. Both sides read the same columns, so that Spark shuffles the index once.
        near = index.alias("a").join(index.alias("b"), F.expr(f"a.word = b.word AND a.id < b.id AND {_may_match('a', 'b')} AND (a.doc <= b.due OR b.doc <= a.due)"))
        return near.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))

    more = common.written(_later(_by_passes(spark, f"{path}/pairs", to_earlier), reps, f"{path}/rest"), f"{path}/more")
    return reps.select("id", "place").join(settled.unionByName(more).distinct(), "id", "left_anti").select("place.k", "place.n")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, n_lines, removed): for each row of docs its id, lines that are not blank, and the numbers of the removed ones from 0."""
    numbered = _numbered(docs, id_col, text_col)
    stay = survivors(numbered, common.workspace(docs.sparkSession)).groupBy("k").agg(F.collect_list("n").alias("stay"))
    there = F.array_compact(F.transform(_plain_lines("t"), lambda line, n: F.when(F.ltrim(line) != "", n)))
    whole = numbered.select("k", "i", there.alias("there")).join(stay, "k", "left")
    return whole.select("i", F.size("there").alias("n_lines"), F.array_except("there", F.coalesce("stay", F.array().cast("array<int>"))).alias("removed"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later lines taken out of their texts; rows whose lines all go keep an empty text."""
    numbered = _numbered(docs, id_col, text_col)
    stay = survivors(numbered, common.workspace(docs.sparkSession)).groupBy("k").agg(F.collect_list("n").alias("stay"))
    whole = numbered.select("k", "t", "row").join(stay, "k", "left")
    stays = F.coalesce("stay", F.array().cast("array<int>"))
    kept = F.filter(F.split("t", "\n"), lambda line, n: F.array_contains(stays, n) | ~line.rlike(NOT_BLANK))
    text = F.when(F.col(f"row.{text_col}").isNotNull(), F.array_join(kept, "\n"))
    return whole.select(*[(text.alias(c) if c == text_col else F.col("row")[c].alias(c)) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decide(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("i").alias("doc_id"), F.col("n_lines").cast("long"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))
