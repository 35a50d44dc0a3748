"""Finds of word lists as an editor sees them: the longest term wins, exceptions and protected names stay, replacements take the case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import excepted, lexicon_issues


def longest(finds: DataFrame, keys: tuple[str, ...], rule: str = "rule_name") -> DataFrame:
    """Of each rule's finds in one text (keys) that overlap, the first from the left, of those the longest, then the smallest replacement.

    A find that overlaps a kept one is gone, and those after it may stay. Only finds that hang together by overlaps are folded in
    one row; a find that nothing overlaps is a fold of one. Null keys are a text of their own; other columns are kept.
    """
    by = [*keys, rule]
    rest = [c for c in finds.columns if c not in (*by, "start", "end", "replacement")]
    item = F.struct("start", (-F.col("end")).alias("back"), "replacement", *rest)
    order = Window.partitionBy(*by).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # The finds that overlap others and those that do not both read one shuffle by text.
    apart = finds.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    chained = apart.withColumn("_alone", (F.col("_new") == 1) & (F.lead("_new", 1, 1).over(order) == 1)).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = chained.where("NOT _alone").groupBy(*by, "_chain").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    none = F.filter("_all", lambda x: F.lit(False))
    step = lambda a, x: F.when(x["start"] >= a["until"], F.struct((-x["back"]).alias("until"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    folded = F.aggregate("_all", F.struct(F.lit(0).alias("until"), none.alias("kept")), step)["kept"]
    chosen = kept.select(*by, F.explode(folded).alias("_k")).select(*by, *[f"_k.{c}" for c in rest], "_k.start", (-F.col("_k.back")).alias("end"), "_k.replacement")
    return chained.where("_alone").select(*chosen.columns).unionAll(chosen)


def in_case(replacement: str | Column, flagged: str | Column) -> Column:
    """The replacement with a capital where the flagged text has one."""
    replacement, flagged = (F.col(c) if isinstance(c, str) else c for c in (replacement, flagged))
    first = F.substring(flagged, 1, 1)
    return F.when((first != F.lower(first)), F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))).otherwise(replacement)


def guarded(sents: DataFrame, lexicon: DataFrame, exceptions: DataFrame, protected: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """(keys, rule_name, severity, start, end, flagged, replacement) of sents (keys, sentence).

    The longest terms are chosen before exceptions and protected names are asked, so a short term within an excepted long one is
    not flagged either. exceptions are (rule_type or *, term), protected are (term), whole words in any case: tables of a
    deployment, broadcast as the lexicon is. Names are looked up with the terms, in one pass over the texts, and a find lies in
    one if a name that begins no later ends no earlier.
    """
    # A sign before the rule tells terms from names; it goes again below.
    terms = lexicon.withColumn("rule_type", F.concat(F.lit("+"), "rule_type"))
    names = protected.selectExpr("'-' AS rule_type", "term", "'' AS replacement", "'low' AS severity", "false AS case_sensitive")
    found = lexicon_issues(sents.select(*keys, "sentence"), terms.unionByName(names)).select(*keys, "rule_name", "severity", "start", "end", "flagged", "replacement")
    is_name = F.coalesce(F.col("rule_name") == "-", F.lit(False))
    held = F.max(F.when(is_name, F.col("end"))).over(Window.partitionBy(*keys).orderBy("start"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    met = found.withColumn("_held", F.coalesce(known & (held >= F.col("end")), F.lit(False))).where(~is_name).withColumn("rule_name", F.substring("rule_name", 2, 1 << 30))
    left = excepted(longest(met, keys), F.broadcast(exceptions)).where("NOT _held")
    return left.select(*keys, "rule_name", "severity", "start", "end", "flagged", in_case("replacement", "flagged").alias("replacement"))
