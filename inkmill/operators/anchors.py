"""Places of what another program reports: batches of blocks with their offsets, and quotes that are not quite the text.

`batches` packs blocks as an outside checker is sent them, with each block's range in code points and in UTF-16 units (what
such checkers count in); `resolve` maps their matches back by range and drops those that run over a block's end.

`anchor` finds where a quote with a few edits stands. A quote is dealt into one part more than it may have edits, k + 1, so a
window with e edits holds k + 1 - e parts unedited, each within k of its diagonal. Every text is searched once for the parts of its
quote, in stretches with what their last windows take beyond them; a stretch is a row and needs no other one, so a text is not
moved after it has met its quotes. Bands of starts go on with their parts' number and their nearest window of those that begin where a part
says. Only windows that may still be nearer than the quote's nearest so far, or as near and earlier, are compared, by Spark's own
banded edit distance, first with the quote's own length alone, which is at most WIDER off.

Null texts and quotes are empty and give nothing; quotes shorter than SHORTEST give nothing; repeated quotes are placed
each; ties go to the fewest edits, then the earliest start, then the length nearest to the quote's, then the shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .content import greedy_chunks
from .spanmaps import let

SEPARATOR = "\n\n"
LIMIT = 6000

SHORTEST = 8
#: Edits allowed, as a share of the quote's length; a window is up to WIDER characters longer or shorter than the quote.
SHARE, WIDER = 0.15, 2


def utf16(c: str | Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(T.col(c), "UTF-16LE")) / 2).cast("long")


def batches(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """blocks (doc_id, block_idx, content) with batch, start and end (code points), start16 and end16 in the batch's text.

    Blocks are followed by SEPARATOR; a batch ends before the block that would take it over the limit. Blank ones are left out.
    """
    some = blocks.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    lists = some.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_idx", (F.length("content") + len(SEPARATOR)).cast("long").alias("size")))).alias("l"))
    dealt = lists.select("doc_id", F.explode(F.arrays_zip(F.col("l.block_idx").alias("block_idx"), greedy_chunks(F.col("l.size"), limit).alias("batch"))).alias("x")).select("doc_id", "x.*")
    before = Window.partitionBy("doc_id", "batch").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda size: F.coalesce(F.sum(size + len(SEPARATOR)).over(before), F.lit(0)).cast("long")
    placed = some.join(dealt, ["doc_id", "block_idx"]).withColumns({"start": so_far(F.length("content")), "start16": so_far(utf16("content"))})
    return placed.withColumns({"end": F.col("start") + F.length("content"), "end16": F.col("start16") + utf16("content")})


def batch_texts(placed: DataFrame) -> DataFrame:
    """(doc_id, batch, text) as it is sent."""
    parts = placed.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("block_idx", "content"))).alias("l"))
    return parts.select("doc_id", "batch", F.concat(F.array_join("l.content", SEPARATOR), F.lit(SEPARATOR)).alias("text"))


def resolve(matches: DataFrame, placed: DataFrame) -> DataFrame:
    """matches (doc_id, batch, offset, length, in UTF-16 units) in their blocks: block_idx, start, end, flagged. Those that spill are dropped.

    A batch holds LIMIT characters, so a match meets a bounded number of blocks.
    """
    on = (F.col("m.doc_id") == F.col("b.doc_id")) & (F.col("m.batch") == F.col("b.batch")) & (F.col("m.offset") >= F.col("b.start16")) & (F.col("m.offset") + F.col("m.length") <= F.col("b.end16"))
    met = matches.alias("m").join(placed.alias("b"), on).select("m.*", "b.block_idx", "b.content", (F.col("m.offset") - F.col("b.start16")).cast("int").alias("o"))
    start = T.utf16_to_code_point(F.col("content"), F.col("o"))
    end = T.utf16_to_code_point(F.col("content"), (F.col("o") + F.col("length")).cast("int"))
    found = met.withColumns({"start": start, "end": end})
    return found.select(*matches.columns, "block_idx", "start", "end", F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")).alias("flagged"))


#: Characters of a text that are looked at together: no place is found by counting from the start of a long text.
PIECE = 128
STRETCH = 8 * PIECE


def _parts(text: str, n: Column) -> Column:
    """Array of (at, part): the text in n parts of nearly one length."""
    edge = lambda i: F.floor(i * F.length(text) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(edge(i).alias("at"), F.substring(F.col(text), edge(i) + 1, edge(i + 1) - edge(i)).alias("part")))


def _any_ahead(parts: str) -> Column:
    """A pattern that matches, of no width, wherever one of the parts begins."""
    quoted = F.transform(F.array_distinct(f"{parts}.part"), lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?="), F.array_join(quoted, "|"), F.lit(")"))


def _stretches(text: str, more: Column) -> Column:
    """Array of the text's stretches of STRETCH characters, cut in one pass, each with `more` of the characters after it."""
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    after = lambda l, p: F.substring(F.array_join(F.slice(l, p + 2, F.ceil(more / STRETCH).cast("int")), ""), F.lit(1), more)
    return let(cut, lambda l: F.transform(l, lambda x, p: F.concat(x, after(l, p))))


def anchor(quotes: DataFrame, texts: DataFrame, share: float = SHARE) -> DataFrame:
    """(quote_id, start, end, edits) of the window of each quote's text that is nearest to it, within share of its length in edits.

    quotes: (quote_id, doc_id, quote), quote_id unique; texts: (doc_id, text), doc_id unique. share is 0.3 at most.
    """
    if not 0 <= share <= 0.3:
        raise ValueError("beyond 0.3, a part of a quote may be too short to be looked for")
    asked = quotes.where(F.length("quote") >= SHORTEST).withColumns({"m": F.length("quote"), "k": F.floor(share * F.length("quote")).cast("int")})
    met = texts.where("text <> ''").join(asked, "doc_id").withColumn("parts", _parts("quote", F.col("k") + 1))
    # A window that starts in a stretch ends at most so far behind it.
    pieces = met.select("quote_id", "quote", "m", "k", "parts", _any_ahead("parts").alias("ahead"), F.posexplode(_stretches("text", F.col("m") + WIDER - 1)).alias("p", "piece"))
    # Parts begin where the split has cut, or at the start, where it cuts nothing off.
    begins = F.expr("aggregate(split(piece, ahead, -1), array(0), (a, x) -> array_append(a, element_at(a, -1) + length(x)))")
    longest = F.array_max(F.transform("parts.part", F.length))
    there = lambda j: let(F.substring(F.col("piece"), j + 1, longest), lambda t: F.filter("parts", lambda x: F.startswith(t, x["part"])))
    placed = F.flatten(F.transform(begins, lambda j: F.transform(there(j), lambda x: F.struct((j - x["at"]).alias("d"), x["at"].alias("at")))))
    found = pieces.select("quote_id", "quote", "m", "k", "p", "piece", F.explode(F.array(placed)).alias("placed"))
    # A window around an unedited part starts within k of the part's diagonal: in one of two bands.
    width = F.expr("2 * k + 1")
    low, high = (lambda d: F.floor((d - F.col("k")) / width).cast("int")), (lambda d: F.floor((d + F.col("k")) / width).cast("int"))
    either = F.array_distinct(F.flatten(F.transform("placed", lambda x: F.array(low(x["d"]), high(x["d"])))))
    bands = found.select("quote_id", "quote", "m", "k", "p", "piece", "placed", F.explode(either).alias("band"))
    first, last = F.greatest(F.col("band") * width, F.lit(0)), F.least((F.col("band") + 1) * width, F.lit(STRETCH)) - 1
    here = F.filter("placed", lambda x: (low(x["d"]) == F.col("band")) | (high(x["d"]) == F.col("band")))
    counted = bands.withColumns({"first": first, "last": last, "placed": here}).where("first <= last").withColumn("n", F.size(F.array_distinct("placed.at")))
    text = F.substring("piece", F.col("first") + 1, F.col("last") - F.col("first") + F.col("m") + WIDER)
    # A likely window of the band: its first part found tells the start, its last one the end.
    opening = F.array_min(F.transform(F.filter("placed", lambda x: x["d"].between(F.col("first"), F.col("last"))), lambda x: F.struct(x["at"], x["d"])))["d"]
    closing = lambda d: F.array_max(F.transform("placed", lambda x: F.struct(x["at"], -F.abs(x["d"] - d), x["d"].alias("d"))))["d"]
    opened = counted.withColumn("opening", opening).withColumn("closing", F.when(F.col("n") > 1, closing(F.col("opening"))))
    told = opened.select("quote_id", "quote", "m", "k", "n", (F.col("p") * STRETCH + F.col("first")).alias("first"), (F.col("last") - F.col("first")).alias("more"), text.alias("text"), (F.col("opening") - F.col("first")).alias("at"), (F.col("closing") - F.col("opening")).alias("wider"))
    # The distance is -1 beyond the edits allowed.
    edits = lambda a, n, most: F.call_function("levenshtein", F.col("quote"), F.substring(F.col("text"), a + 1, n), most)
    sizes = lambda a: F.filter(F.sequence(F.col("m") - WIDER, F.col("m") + WIDER), lambda n: (n > 0) & (a + n <= F.length("text")))
    window = lambda a, n, most: F.struct(edits(a, n, most).alias("edits"), (F.col("first") + a).alias("start"), F.abs(n - F.col("m")).alias("off"), n.alias("size"))
    best_of = lambda windows: F.array_min(F.filter(windows, lambda x: x["edits"] >= 0))
    # A single part found leaves k edits at least, which says no more than k itself.
    size = F.col("m") + F.greatest(F.lit(-WIDER), F.least(F.lit(WIDER), "wider"))
    nearest = F.when(F.col("wider").isNotNull() & (F.col("at") + size <= F.length("text")), F.filter(F.array(window(F.col("at"), size, F.col("k"))), lambda x: x["edits"] >= 0))
    bound = told.withColumn("nearest", F.get(nearest, F.lit(0))).drop("at", "wider").withColumn("so_far", F.min("nearest").over(Window.partitionBy("quote_id")))
    # A window must have fewer edits than the nearest so far, or as many and not start after it.
    most = lambda start: F.when(F.col("so_far").isNull(), F.col("k")).when(start <= F.col("so_far.start"), F.col("so_far.edits")).otherwise(F.col("so_far.edits") - 1)
    may = lambda a: let(most(F.col("first") + a), lambda e: (F.col("k") + 1 - F.col("n") <= e) & (e >= 0) & (edits(a, F.col("m"), e + WIDER) >= 0))
    nearer = best_of(F.flatten(F.transform(F.filter(F.sequence(F.lit(0), "more"), may), lambda a: F.transform(sizes(a), lambda n: window(a, n, most(F.col("first") + a))))))
    tried = F.when(F.col("k") + 1 - F.col("n") <= most(F.col("first")), nearer)
    best = bound.select("quote_id", F.least("so_far", tried).alias("w")).groupBy("quote_id").agg(F.min("w").alias("b")).where("b IS NOT NULL")
    return best.select("quote_id", F.col("b.start").cast("long").alias("start"), (F.col("b.start") + F.col("b.size")).cast("long").alias("end"), "b.edits")
