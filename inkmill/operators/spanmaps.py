"""Offset maps from cleaned text back to its source, as rows of runs, and spans and ranges carried through them.

A cleaning step replaces every find of a pattern; its map is a run-length table, one row a stretch of text:

    at, n       place and length in the cleaned text
    src, width  place and length in the source
    kept        the stretch is the source's own (then width = n), or stands for the `width` characters from src on

Steps are composed by intersecting the runs of both in the text between them, with one sort by key; spans are looked up by
an as-of search in the same manner. Rows of one key (a document, or a block) are sorted in one task, which spills; no list
of characters is ever made. Where a flagged text is not at the place that the map gives, `refind` looks for it near by.

Where only finds are to be followed, `traced` needs no composed map: a text goes through all steps in one projection, and
the finds go back through the steps' own maps, one after the other. The whole map is for `carried` and lookups of any kind.

Null texts are empty; an empty text has no runs; spans that lie outside of every run come back as null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUN = ("at", "n", "src", "width", "kept")


@dataclass(frozen=True)
class Step:
    """Replaces each find of a pattern (of three groups: before, kept, after) by its second group, or by put(find).

    The pattern never matches empty text.
    """

    pattern: str
    put: Callable[[Column], Column] | None = None


def delete(pattern: str) -> Step:
    return fixed(pattern, "")


def keep(before: str, kept: str, after: str) -> Step:
    return Step(f"({before})({kept})({after})")


def fixed(pattern: str, text: str) -> Step:
    return Step(f"({pattern})()()", lambda _: F.lit(text))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: bound to a lambda's variable, so that no plan or code repeats it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(text: Column, step: Step) -> Column:
    """Array of (gap, hit), and where a group is kept, (before, kept): the text cut at the finds; the last piece has no hit."""
    every = lambda group: F.regexp_extract_all(text, F.lit(step.pattern), F.lit(group))
    groups = [] if step.put else [every(1).alias("before"), every(2).alias("kept")]
    return F.arrays_zip(F.split(text, step.pattern, -1).alias("gap"), every(0).alias("hit"), *groups)


def _instead(step: Step, x: Column) -> Column:
    return F.coalesce(step.put(x["hit"]) if step.put else x["kept"], F.lit(""))


def cleaned(text: Column, step: Step) -> Column:
    """The text after a step."""
    return let(text, lambda t: F.array_join(F.transform(_pieces(t, step), lambda x: F.concat(x["gap"], F.when(x["hit"].isNull(), "").otherwise(_instead(step, x)))), ""))


def _sizes(text: Column, step: Step) -> Column:
    """Array of the lengths of the pieces: gap, hit, what comes before the kept part, and what stands instead."""
    zero = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    one = lambda x: F.struct(zero(x["gap"]).alias("gap"), zero(x["hit"]).alias("hit"), (F.lit(0).cast("long") if step.put else zero(x["before"])).alias("before"), F.when(x["hit"].isNull(), F.lit(0).cast("long")).otherwise(zero(_instead(step, x))).alias("new"))
    return let(text, lambda t: F.transform(_pieces(t, step), one))


def runs(texts: DataFrame, step: Step, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """keys and RUN of one step over texts."""
    each = texts.select(*keys, F.posexplode(_sizes(F.coalesce(F.col(text), F.lit("")), step)).alias("i", "x")).select(*keys, "i", "x.*")
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumns({"at": F.coalesce(F.sum(F.expr("gap + new")).over(before), F.lit(0)), "src": F.coalesce(F.sum(F.expr("gap + hit")).over(before), F.lit(0))})
    run = lambda at, n, src, width, kept: F.expr(f"named_struct('at', {at}, 'n', {n}, 'src', {src}, 'width', {width}, 'kept', {kept})")
    own = run("at", "gap", "src", "gap", "true")
    other = run("at + gap", "new", "src + gap", "hit", "false") if step.put else run("at + gap", "new", "src + gap + before", "new", "true")
    return placed.select(*keys, F.explode(F.array(own, other)).alias("r")).select(*keys, "r.*").where("n > 0")


def compose(upper: DataFrame, lower: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The map of `lower` followed by `upper`: runs of both meet in the text between them, and each meeting is a run.

    The boundaries of both are sorted together, so a boundary knows the runs that it lies in; the stretch up to the next
    boundary is in one run of each. A run of upper that stands for several stretches stays one.
    """
    whole = lambda df, pos, name: df.select(*keys, F.col(pos).alias("pos"), F.struct(*RUN).alias(name))
    edges = whole(upper, "src", "u").withColumn("l", F.lit(None).cast(whole(lower, "at", "l").schema["l"].dataType))
    edges = edges.unionByName(whole(lower, "at", "l").withColumn("u", F.lit(None).cast(edges.schema["u"].dataType)))
    met = edges.groupBy(*keys, "pos").agg(F.max("u").alias("u"), F.max("l").alias("l"))
    order = Window.partitionBy(*keys).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = met.select(*keys, "pos", F.last("u", ignorenulls=True).over(upto).alias("u"), F.last("l", ignorenulls=True).over(upto).alias("l"), F.lead("pos").over(order).alias("next"))
    end = F.least(F.coalesce("next", F.expr("u.src + u.width")), F.expr("u.src + u.width"), F.expr("l.at + l.n"))
    inside = cut.where("u IS NOT NULL AND l IS NOT NULL").withColumn("stop", end).where("pos < stop")
    stretch = inside.selectExpr(
        *keys, "CASE WHEN u.kept THEN u.at + (pos - u.src) ELSE u.at END AS at", "CASE WHEN u.kept THEN stop - pos ELSE u.n END AS n",
        "CASE WHEN l.kept THEN l.src + (pos - l.at) ELSE l.src END AS src", "CASE WHEN l.kept THEN l.src + (stop - l.at) ELSE l.src + l.width END AS over", "u.kept AND l.kept AS kept",
    )
    one = stretch.groupBy(*keys, "at").agg(F.max("n").alias("n"), F.min("src").alias("src"), (F.max("over") - F.min("src")).alias("width"), F.bool_and("kept").alias("kept"))
    return one.select(*keys, *RUN)


def clean(texts: DataFrame, steps: list[Step], keys: tuple[str, ...], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keys, text) after all steps, and the runs of the composed map."""
    # Texts are dealt by key once; runs, boundaries and lookups of a key stay where its text is.
    now, total = texts.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text")).repartition(*keys), None
    for step in steps:
        own = runs(now, step, keys)
        total = own if total is None else compose(own, total, keys)
        now = now.select(*keys, cleaned(F.col("text"), step).alias("text"))
    return now, total


def lookup(spans: DataFrame, total: DataFrame, keys: tuple[str, ...], start: str = "start", end: str = "end") -> DataFrame:
    """spans with raw_start and raw_end: their first and last characters are looked up among the runs, as of their places."""
    rest = [c for c in spans.columns if c not in keys]
    asked = spans.select(*keys, F.struct(*rest).alias("span"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    asked = asked.withColumn("pos", F.when(F.col("side") == 0, F.col("span")[start]).otherwise(F.greatest(F.col("span")[end] - 1, F.col("span")[start])).cast("long"))
    run = total.select(*keys, F.col("at").alias("pos"), F.struct(*RUN).alias("r"))
    both = run.unionByName(asked, allowMissingColumns=True)
    # Runs come before the spans that begin where they do.
    upto = Window.partitionBy(*keys).orderBy("pos", F.col("side").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("r", F.last("r", ignorenulls=True).over(upto)).where("side IS NOT NULL")
    place = F.expr("CASE WHEN pos < r.at OR pos >= r.at + r.n THEN NULL WHEN side = 0 THEN r.src + CASE WHEN r.kept THEN pos - r.at ELSE 0 END ELSE r.src + CASE WHEN r.kept THEN pos - r.at + 1 ELSE r.width END END")
    # Spans that are repeated give the same places: one row a side is enough, and their number is kept.
    sides = found.groupBy(*keys, "span").agg(F.min(F.when(F.col("side") == 0, place)).alias("raw_start"), F.max(F.when(F.col("side") == 1, place)).alias("raw_end"), F.sum(1 - F.col("side")).alias("times"))
    repeated = sides.select(*keys, "span.*", "raw_start", "raw_end", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return repeated.select(*spans.columns, "raw_start", "raw_end")


def _levels(text: Column, steps: list[Step], pattern: str) -> Column:
    """The pieces of every step, in the text that the steps before it leave, and those of the finds (the level after the steps).

    Each text is made once. A piece is a gap and the hit after it; `made` is the length of what stands for the hit.
    """
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")

    def piece(level: int, x: Column, i: Column, before: Column, made: Column, flagged: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), i.alias("i"), size(x["gap"]).alias("gap"), size(x["hit"]).alias("hit"), before.alias("before"), made.alias("made"), flagged.alias("flagged"))

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")

    def follow(t: Column, k: int) -> Column:
        if k == len(steps):
            return F.transform(_pieces(t, Step(f"({pattern})", lambda hit: hit)), lambda x, i: piece(k, x, i, zero, size(x["hit"]), x["hit"]))
        step = steps[k]

        def cut(pieces: Column) -> Column:
            own = F.transform(pieces, lambda x, i: piece(k, x, i, zero if step.put else size(x["before"]), size(x["new"]), none))
            left = F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], x["new"])), "")
            return F.concat(own, let(left, lambda t: follow(t, k + 1)))

        with_new = lambda x: x.withField("new", F.when(x["hit"].isNull(), "").otherwise(_instead(step, x)))
        return let(F.transform(_pieces(t, step), with_new), cut)

    return let(text, lambda t: follow(t, 0))


def finds_of(texts: DataFrame, patterns: list[str], keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keys, level, start, end, flagged): the finds of several patterns, each by itself; level is the pattern's place in the list.

    Texts are read once and not dealt by key; only finds are.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    at_level = lambda k: lambda x: x.withField("level", F.lit(k))
    found = F.concat(*[F.transform(_levels(body, [], p), at_level(k)) for k, p in enumerate(patterns)])
    hits = texts.select(*keys, F.explode_outer(found).alias("x")).select(*keys, "x.level", "x.i", "x.gap", "x.hit", "x.flagged").where("hit > 0").repartition(*keys)
    upto = Window.partitionBy(*keys, "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("end", F.sum(F.expr("gap + hit")).over(upto)).select(*keys, "level", (F.col("end") - F.col("hit")).alias("start"), "end", "flagged")


def traced(texts: DataFrame, steps: list[Step], pattern: str, keys: tuple[str, ...], guard: str | None = None, text: str = "text") -> DataFrame:
    """(keys, start, end, flagged, raw_start, raw_end): the finds of a pattern in the cleaned texts, and their places in the source.

    Finds that begin, in the source, in a find of `guard` are left out. Pieces and finds of a key are sorted in one task
    for each step, which spills; a partitioning of texts by the keys is kept.
    """
    body, n = F.coalesce(F.col(text), F.lit("")), len(steps)
    first = 0 if guard is None else -1
    pieces = _levels(body, steps, pattern)
    if guard is not None:
        # The source's own ranges: a step before the others that changes nothing.
        own = _levels(body, [], guard)
        pieces = F.concat(pieces, F.transform(own, lambda x: x.withField("level", F.lit(-1)).withField("flagged", F.lit(None).cast("string"))))
    rows = texts.select(*keys, F.explode_outer(pieces).alias("x")).select(*keys, "x.*")
    before = Window.partitionBy(*keys, "level").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"at": F.coalesce(F.sum(F.expr("gap + made")).over(before), F.lit(0)), "src": F.coalesce(F.sum(F.expr("gap + hit")).over(before), F.lit(0))})
    # A find asks for two places, its first character's (side 0) and its last one's (side 1); a piece has no side.
    ends = F.when(F.col("level") == n, F.expr("array(0, 1)")).otherwise(F.expr("array(CAST(NULL AS INT))"))
    asked = placed.where(f"level < {n} OR hit > 0").select("*", F.explode(ends).alias("side")).selectExpr(
        *keys, "level", "i", "side", "CASE WHEN side = 0 THEN src + gap WHEN side = 1 THEN src + gap + hit - 1 ELSE at END AS pos",
        f"CASE WHEN level < {n} THEN struct(at, src, gap, hit, before, made) END AS piece",
        f"CASE WHEN level = {n} THEN struct(src + gap AS start, src + gap + hit AS end, flagged) END AS find",
    )
    for level in range(n - 1, first - 1, -1):
        # Finds stand at the level of the step that they are looked up in, after the pieces that begin where they do.
        asked = asked.withColumn("level", F.when(F.col("side").isNotNull(), level).otherwise(F.col("level")))
        order = Window.partitionBy(*keys, "level").orderBy("pos", F.col("side").asc_nulls_first(), "i").rowsBetween(Window.unboundedPreceding, 0)
        met = asked.withColumn("of", F.last("piece", ignorenulls=True).over(order)).where(f"side IS NOT NULL OR level <> {level}")
        if level < 0:
            met = met.where("NOT (side = 0 AND pos - of.at >= of.gap)")
            asked = met.drop("of")
            continue
        kept = steps[level].put is None
        inside = "of.src + of.gap + of.before + (pos - of.at - of.gap)" if kept else "of.src + of.gap + CASE WHEN side = 1 THEN of.hit - 1 ELSE 0 END"
        asked = met.withColumn("pos", F.expr(f"CASE WHEN side IS NULL THEN pos WHEN pos - of.at < of.gap THEN of.src + (pos - of.at) ELSE {inside} END")).drop("of")
    both = asked.groupBy(*keys, "i").agg(F.first("find").alias("find"), F.max(F.expr("CASE WHEN side = 0 THEN pos END")).alias("raw_start"), F.max(F.expr("CASE WHEN side = 1 THEN pos + 1 END")).alias("raw_end"))
    return both.where("raw_start IS NOT NULL").select(*keys, "find.*", "raw_start", "raw_end")


def nearest(text: Column, wanted: Column, hint: Column) -> Column:
    """The place of wanted in text that is closest to hint, the earlier of two alike; -1 if there is none. Overlapping places count."""
    place = lambda head, size: lambda back: F.when(back > 0, F.length(head) - back + 1 - size)
    left = let(F.reverse(F.substring(text, F.lit(1), hint + F.length(wanted))), lambda head: let(F.call_function("locate", F.reverse(wanted), head), place(head, F.length(wanted))))
    right = let(F.call_function("locate", wanted, text, hint + 1), lambda at: F.when(at > 0, at - 1))
    sides = F.struct(left.alias("left"), right.alias("right"))
    chosen = lambda p: F.when(p["left"].isNull(), p["right"]).when(p["right"].isNull() | (hint - p["left"] <= p["right"] - hint), p["left"]).otherwise(p["right"])
    return F.when(F.length(wanted) == 0, F.lit(-1)).otherwise(F.coalesce(let(sides, chosen), F.lit(-1)))


def refind(text: Column, flagged: Column, approx: Column) -> Column:
    """The span (start, end) of flagged nearest to approx: within three lengths and 200 signs, then without case, then anywhere.

    (-1, -1) where the text has it nowhere. Markers before it ("- ", "1. ", "## ", "> ") are not looked for.
    """
    plain = F.regexp_replace(flagged, "^(?:[-*>] |[0-9]+\\. |#{1,6} )", "")
    reach = F.length(plain) * 3 + 200
    begin = F.greatest(approx.cast("int") - reach, F.lit(0))
    ask = F.struct(plain.alias("wanted"), begin.alias("begin"), F.substring(text, begin + 1, approx.cast("int") + reach - begin).alias("window"), (approx.cast("int") - begin).alias("hint"))

    def near(q: Column) -> Column:
        shift = lambda at: F.when(at >= 0, q["begin"] + at)
        same, loose = let(nearest(q["window"], q["wanted"], q["hint"]), shift), let(nearest(F.lower(q["window"]), F.lower(q["wanted"]), q["hint"]), shift)
        start = F.coalesce(same, loose, nearest(text, q["wanted"], q["begin"] + q["hint"]))
        return let(start, lambda at: F.struct(at.cast("long").alias("start"), F.when(at >= 0, at + F.length(q["wanted"])).otherwise(-1).cast("long").alias("end")))

    return let(ask, near)


# -- ranges


def ranges(texts: DataFrame, pattern: str, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(keys, r_start, r_end): the finds of a pattern, such as inline code."""
    found = runs(texts, Step(f"({pattern})()()", lambda hit: hit), keys, text).where("NOT kept")
    return found.selectExpr(*keys, "src AS r_start", "src + width AS r_end")


def carried(found: DataFrame, total: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ranges of the source in the cleaned text, merged. Ranges that are cleaned away are gone.

    The runs in order tile both texts, so what they have of a range is one stretch, from the first run that ends after
    the range's begin to the last one that begins before its end: two as-of lookups, whatever the lengths.
    """
    run = F.struct(*RUN).alias("r")
    first = total.select(*keys, (F.col("src") + F.col("width")).alias("pos"), F.lit(0).alias("side"), run)
    last = total.select(*keys, F.col("src").alias("pos"), F.lit(1).alias("side"), run)
    ranged = found.where("r_start < r_end").distinct().select(*keys, F.struct("r_start", "r_end").alias("range"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    asks = ranged.withColumn("pos", F.when(F.col("side") == 0, F.col("range.r_start")).otherwise(F.col("range.r_end")))
    rows = first.unionByName(last).unionByName(asks, allowMissingColumns=True)
    # A run that ends at a range's begin, or begins at its end, has nothing of it: such runs stand on the far side.
    order = Window.partitionBy(*keys, "side").orderBy("pos", F.when(F.col("side") == 0, F.col("range").isNotNull()).otherwise(F.col("range").isNull()), "r.at")
    after = F.first("r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    upto = F.last("r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("r", F.when(F.col("side") == 0, after).otherwise(upto)).where("range IS NOT NULL")
    begin = F.expr("CASE WHEN side = 0 THEN r.at + CASE WHEN r.kept THEN greatest(range.r_start - r.src, 0) ELSE 0 END END")
    end = F.expr("CASE WHEN side = 1 THEN r.at + CASE WHEN r.kept THEN least(range.r_end - r.src, r.n) ELSE r.n END END")
    inside = met.groupBy(*keys, "range").agg(F.max(begin).alias("r_start"), F.max(end).alias("r_end")).drop("range").where("r_start < r_end")
    return merged(inside, keys)


#: Characters in a bin of the interval joins.
BIN = 64


def merged(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ranges that touch or overlap become one, by key."""
    order = Window.partitionBy(*keys).orderBy("r_start", "r_end")
    reach = F.max("r_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("r_start") > reach), 1).otherwise(0)
    islands = found.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")).drop("island")


def outside(issues: DataFrame, guards: DataFrame, keys: tuple[str, ...], start: str = "start", end: str = "end") -> DataFrame:
    """Issues that do not begin in a guarded range of theirs. Guards are merged first, so an issue meets one range at most a bin."""
    binned = merged(guards, keys).withColumn("bin", F.explode(F.sequence(F.floor(F.col("r_start") / BIN), F.floor((F.col("r_end") - 1) / BIN))))
    at = F.col(f"i.{start}")
    same = [F.col(f"i.{k}") == F.col(f"g.{k}") for k in keys]
    on = F.floor(at / BIN) == F.col("g.bin")
    for c in same:
        on = on & c
    return issues.alias("i").join(binned.alias("g"), on & (F.col("g.r_start") <= at) & (at < F.col("g.r_end")), "left_anti")
