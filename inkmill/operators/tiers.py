"""Merging the issues of several finders: the first come is kept, and what repeats a kept one goes.

Each finder's issues come in an order (`ord`, by document). An issue goes if an earlier one that is kept itself repeats it,
so the result depends on the order, as a fold over the document would. Documents of up to FOLD issues are folded. The others,
for which a fold would go by the square of their issues in one task, are computed in rounds without lists of pairs of
equal texts: texts are groups, and a group only needs its first undecided and its first kept member. An issue without an
earlier undecided rival is decided; a chain of rivals takes as many rounds as half its length.

Rivals are: issues of one text (group), issues whose texts' words contain each other's (groups joined by an inverted index
of words and word pairs), and issues whose spans overlap (pairs by bins). Spans of (0, 0) are unknown and overlap nothing.

Texts are compared stripped and lower-cased; null and blank ones repeat nothing and are always kept; repeated rows are
told apart by `ord` alone, so (doc_id, ord) must not repeat; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .rounds import cut

#: The editorial group of each category. Issues of different groups never repeat each other.
GROUPS = {
    "style": "language",
    "grammar": "language",
    "word-usage": "language",
    "punctuation": "punctuation",
    "structure": "structure",
    "modular": "structure",
    "numbers": "technical",
    "technical": "technical",
    "references": "technical",
    "audience": "audience",
    "legal": "audience",
}
#: Characters in a bin of the search for overlapping spans.
BIN = 256
#: Issues of a document that is folded; documents of more go through rounds.
FOLD = 256


def norm(c: str | Column) -> Column:
    """Comparison form of a flagged text; blanks between words are one space."""
    return F.lower(T.collapse(F.coalesce(T.col(c), F.lit(""))))


def broad(c: str) -> Column:
    """The group of categories that issues are compared in; no category is a group, and all others that are not known are one."""
    known = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    return F.when(F.col(c).isNull(), "unknown").otherwise(F.coalesce(F.try_element_at(known, F.col(c)), F.lit("other")))


def overlaps(issues: DataFrame, share: float, same: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, a, b): issues a < b that agree in `same` and whose spans overlap by more than share of the shorter one."""
    keys = ["doc_id", *same]
    spans = issues.where("(start <> 0 OR end <> 0) AND start < end").select(*keys, "ord", "start", "end")
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))))
    # Two spans meet in the bin where the later one begins, and in no other.
    common = F.least("x.end", "y.end") - F.greatest("x.start", "y.start")
    shorter = F.least(F.col("x.end") - F.col("x.start"), F.col("y.end") - F.col("y.start"))
    on = (F.col("x.bin") == F.col("y.bin")) & (F.col("x.ord") < F.col("y.ord")) & (F.floor(F.greatest("x.start", "y.start") / BIN) == F.col("x.bin")) & (common > share * shorter)
    for k in keys:
        on = on & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return binned.alias("x").join(binned.alias("y"), on).select(F.col("x.doc_id").alias("doc_id"), F.col("x.ord").alias("a"), F.col("y.ord").alias("b"))


def containments(texts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, t, other) both ways, for distinct texts (keys, t) of which one's words run within the other's.

    A text is looked up by its first two words (or its only one) among the words and word pairs of the others.
    """
    words = texts.select(*keys, "t", F.split("t", " ").alias("w"))
    key = lambda w, at: F.array_join(F.slice(w, at, F.least(F.size(w) - at + 1, F.lit(2))), " ")
    short = words.select(*keys, F.col("t").alias("t"), F.col("w").alias("w"), key(F.col("w"), F.lit(1)).alias("head"))
    at = words.select(*keys, F.col("t").alias("other"), F.col("w").alias("v"), F.posexplode("w").alias("p", "one"))
    places = at.select(*keys, "other", "v", "p", F.explode(F.array_distinct(F.array("one", key(F.col("v"), F.col("p") + 1)))).alias("head"))
    met = short.join(places, [*keys, "head"]).where("t <> other AND size(w) <= size(v) AND slice(v, p + 1, size(w)) = w").select(*keys, "t", "other").distinct()
    return met.unionByName(met.select(*keys, F.col("other").alias("t"), F.col("t").alias("other"))).distinct()


def first_kept(nodes: DataFrame, groups: DataFrame, watched: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, ord, kept) for nodes (doc_id, ord, fixed): in order, each is kept unless it has a rival that is kept; fixed ones always are.

    groups: (doc_id, ord, g), the text groups of a node; watched: (doc_id, ord, g), the groups whose members are rivals of
    the node where they come before it; pairs: (doc_id, a, b), a < b, single rivals.
    """
    # Only groups with a member before one of their watchers decide anything, and only nodes that have to do with those, or
    # with pairs, go through the rounds. All others are kept.
    groups, pairs = groups.distinct(), cut(pairs.distinct())
    least = groups.groupBy("doc_id", "g").agg(F.min("ord").alias("least"))
    watched = cut(watched.distinct().join(least, ["doc_id", "g"]).where("least < ord").drop("least"))
    groups = cut(groups.join(watched.select("doc_id", "g").distinct(), ["doc_id", "g"], "left_semi"))
    ends = [pairs.select("doc_id", F.col(c).alias("ord")) for c in ("a", "b")]
    rivals = watched.select("doc_id", "ord").unionByName(groups.select("doc_id", "ord")).unionByName(ends[0]).unionByName(ends[1]).distinct()
    all_nodes = nodes.join(rivals.withColumn("rival", F.lit(True)), ["doc_id", "ord"], "left")
    marked = cut(all_nodes.select("doc_id", "ord", F.when(F.col("fixed") | F.col("rival").isNull(), True).alias("kept"), F.col("rival").isNotNull().alias("rival")))
    alone, state = marked.where("NOT rival").drop("rival"), marked.where("rival").drop("rival")
    while state.where("kept IS NULL").take(1):
        firsts = groups.join(state, ["doc_id", "ord"]).groupBy("doc_id", "g").agg(F.min(F.when(F.col("kept").isNull(), F.col("ord"))).alias("open"), F.min(F.when(F.col("kept"), F.col("ord"))).alias("taken"))
        by_text = watched.join(firsts, ["doc_id", "g"]).select("doc_id", "ord", F.coalesce(F.col("taken") < F.col("ord"), F.lit(False)).alias("beaten"), F.coalesce(F.col("open") < F.col("ord"), F.lit(False)).alias("waits"))
        earlier = state.withColumnRenamed("ord", "a")
        by_span = pairs.join(earlier, ["doc_id", "a"]).select("doc_id", F.col("b").alias("ord"), F.coalesce("kept", F.lit(False)).alias("beaten"), F.col("kept").isNull().alias("waits"))
        seen = by_text.unionByName(by_span).groupBy("doc_id", "ord").agg(F.max("beaten").alias("beaten"), F.max("waits").alias("waits"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = cut(state.join(seen, ["doc_id", "ord"], "left").select("doc_id", "ord", now.alias("kept")))
    return alone.unionByName(state)


def _relation(issues: DataFrame, share: float, same: tuple[str, ...], contain: tuple[str, ...] | None):
    """groups, watched and pairs of issues for first_kept."""
    told = issues.withColumn("t", norm("flagged")).where("t <> ''")
    exact = told.select("doc_id", "ord", F.concat_ws("\x01", F.lit("="), *same, "t").alias("g"))
    groups, watched = exact, exact
    if contain is not None:
        keys = ("doc_id", *contain)
        name = lambda t: F.concat_ws("\x01", F.lit("~"), *contain, t)
        near = containments(told.select(*keys, "t").distinct(), keys)
        groups = groups.unionByName(told.select("doc_id", "ord", name("t").alias("g")))
        watched = watched.unionByName(told.join(near, [*keys, "t"]).select("doc_id", "ord", name("other").alias("g")))
    return groups, watched, overlaps(issues, share, same)


def _overlap(share: float) -> str:
    """SQL: whether the spans of x and y overlap by more than share of the shorter one; (0, 0) is none."""
    return f"x.start < x.`end` AND y.start < y.`end` AND least(x.`end`, y.`end`) - greatest(x.start, y.start) > {share} * least(x.`end` - x.start, y.`end` - y.start)"


def _folded(issues: DataFrame, rivals: str, fixed: str = "false") -> DataFrame:
    """Issues without those that an earlier kept one of their document rivals; rivals: SQL of x (kept) and y; fixed: SQL of y, always kept."""
    rows = issues.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in issues.columns if c != "doc_id"])).alias("l"))
    in_order = "array_sort(l, (a, b) -> CASE WHEN a.ord < b.ord THEN -1 WHEN a.ord > b.ord THEN 1 ELSE 0 END)"
    kept = F.expr(f"aggregate({in_order}, slice(l, 1, 0), (a, y) -> CASE WHEN {fixed} OR NOT exists(a, x -> coalesce({rivals}, false)) THEN array_append(a, y) ELSE a END)")
    return rows.select("doc_id", F.explode(kept).alias("i")).select("doc_id", "i.*").select(*issues.columns)


def _by_size(issues: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The issues of documents to fold, and those of the others, if there are any."""
    large = cut(issues.groupBy("doc_id").count().where(F.col("count") > FOLD).select("doc_id"))
    if not large.take(1):
        return issues, None
    return issues.join(large, "doc_id", "left_anti"), issues.join(large, "doc_id", "left_semi")


def dedup_model(issues: DataFrame) -> DataFrame:
    """Issues (doc_id, ord, source, flagged, start, end) of the passes of a model without those that repeat an earlier kept one.

    One text counts whatever the source, contained words within a source, spans by more than four fifths of the shorter.
    """
    told = issues.withColumn("_t", norm("flagged"))
    blank, some = told.where("_t = ''").drop("_t"), told.where("_t <> ''")
    few, many = _by_size(some)
    within = lambda a, b: f"contains(concat(' ', {a}._t, ' '), concat(' ', {b}._t, ' '))"
    kept = _folded(few, f"x._t = y._t OR (x.source = y.source AND ({within('x', 'y')} OR {within('y', 'x')})) OR ({_overlap(0.8)})").drop("_t").unionByName(blank)
    if many is None:
        return kept
    many = many.drop("_t")
    left = first_kept(many.withColumn("fixed", F.lit(False)), *_relation(many, 0.8, (), ("source",))).where("kept").select("doc_id", "ord")
    return kept.unionByName(many.join(left, ["doc_id", "ord"], "left_semi"))


def merge_tiers(rules: DataFrame, checker: DataFrame, model: DataFrame, confidence: float = 0.7) -> DataFrame:
    """The issues of three tiers (doc_id, ord, source, category, flagged, start, end, confidence) in one table with `tier`.

    Rules' issues all stay. The checker's, then the model's (deduplicated among themselves, and confident enough) stay
    unless they repeat an issue that stays, in one group of categories: by more than half of the shorter span or by text.
    """
    surer = dedup_model(model).where(F.col("confidence") >= confidence)
    tiers = [t.withColumn("tier", F.lit(n)) for n, t in enumerate((rules, checker, surer), 1)]
    every = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    # Tiers come one after the other; within a tier, by the finder's order.
    ranked = cut(every.withColumns({"_ord": F.col("ord"), "ord": F.struct("tier", "ord"), "group": broad("category"), "_t": norm("flagged")}))
    few, many = _by_size(ranked)
    kept = _folded(few, f"x.`group` = y.`group` AND ((y._t <> '' AND x._t = y._t) OR ({_overlap(0.5)}))", "y.tier = 1")
    if many is not None:
        left = first_kept(many.select("doc_id", "ord", (F.col("tier") == 1).alias("fixed")), *_relation(many, 0.5, ("group",), None)).where("kept").select("doc_id", "ord")
        kept = kept.unionByName(many.join(left, ["doc_id", "ord"], "left_semi"))
    return kept.withColumn("ord", F.col("_ord")).drop("_ord", "group", "_t")
