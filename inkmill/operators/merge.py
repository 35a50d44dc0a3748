"""Order-dependent merging: greedy acceptance of issues, first wins.

Within a sentence issues come in `ord`; one is dropped if its category group is that of an accepted one and their texts
agree or their spans overlap by more than half of the shorter. A dropped issue suppresses nothing, which no anti-join
tells, so the issues of a sentence and group are folded in order, in one expression over their array. A group is bounded
by its sentence; one of a single issue, as most are, is not collected at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Broad groups of categories; any other category is a group of its own.
BROAD = {"word-usage": "style", "style": "style", "grammar": "grammar", "structure": "structure", "punctuation": "punctuation"}


def group(category: Column) -> Column:
    found = category
    for name, broad in BROAD.items():
        found = F.when(category == name, broad).otherwise(found)
    return found


def overlap(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Shared characters over the shorter span; 0 for empty spans."""
    shared, shorter = min(a[1], b[1]) - max(a[0], b[0]), min(a[1] - a[0], b[1] - b[0])
    return max(0, shared) / shorter if shorter > 0 else 0.0


def merge(issues: DataFrame) -> DataFrame:
    """Accepted issues. Columns doc_id, ord, category, flagged, sent_idx, start_pos, end_pos are read, all come back."""
    marked = issues.withColumn("_group", group(F.col("category"))).withColumn("_text", F.lower(F.trim(F.coalesce("flagged", F.lit("")))))
    keys = ["doc_id", "sent_idx", "_group"]
    counted = marked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    row = F.struct("ord", "_text", "start_pos", "end_pos", F.struct(*issues.columns).alias("row"))
    listed = counted.where("_n > 1").groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("all"))
    fold = """aggregate(all, filter(all, x -> false), (kept, x) -> CASE WHEN exists(kept, a -> a._text = x._text
        OR 2 * (least(a.end_pos, x.end_pos) - greatest(a.start_pos, x.start_pos)) > least(a.end_pos - a.start_pos, x.end_pos - x.start_pos)
           AND least(a.end_pos - a.start_pos, x.end_pos - x.start_pos) > 0) THEN kept ELSE concat(kept, array(x)) END)"""
    folded = listed.select(F.explode(F.expr(fold)).alias("x")).select("x.row.*")
    return counted.where("_n = 1").select(*issues.columns).unionByName(folded)


def demote(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Issues whose span crosses a block's end lose their suggestions; blocks: doc_id, end_pos."""
    ends = blocks.select(F.col("doc_id").alias("_d"), F.col("end_pos").alias("_e"))
    crossing = issues.join(ends, (F.col("doc_id") == F.col("_d")) & (F.col("_e") > F.col("start_pos")) & (F.col("_e") < F.col("end_pos")), "left_semi").select("doc_id", "ord").distinct()
    flagged = issues.join(crossing.withColumn("_x", F.lit(True)), ["doc_id", "ord"], "left")
    return flagged.withColumn("suggestions", F.when(F.col("_x"), F.array().cast("array<string>")).otherwise(F.col("suggestions"))).drop("_x")


def resolve(issues: DataFrame, text: str = "text") -> DataFrame:
    """Spans in the text: by the sentence and the place in it, else the flagged text, else the sentence, else [0, 0]."""
    c, s, f = F.col(text), F.col("sentence"), F.col("flagged")
    sentence, inside, alone = F.instr(c, s) - 1, F.instr(s, f) - 1, F.instr(c, f) - 1
    start = F.when((sentence >= 0) & (inside >= 0), sentence + inside).when(alone >= 0, alone).when(sentence >= 0, sentence).otherwise(0)
    size = F.when(((sentence >= 0) & (inside >= 0)) | (alone >= 0), F.length(f)).when(sentence >= 0, F.length(s)).otherwise(0)
    return issues.withColumn("start_pos", start).withColumn("end_pos", start + size)


def scrub_suggestions(c: str) -> Column:
    """Suggestions that are instructions, or long against the flagged text, go."""
    return F.filter(F.col(c), lambda s: ~F.lower(s).rlike("^(?:rewrite|consider|remove|use |change|replace|add )") & ~((F.length(s) > 20) & (F.length(s) > 3 * F.length("flagged"))))


def match_case(original: Column, replacement: Column) -> Column:
    """A replacement in the case of the text it replaces."""
    upper = (F.upper(original) == original) & (F.length(original) > 1)
    title = F.substring(original, 1, 1) == F.upper(F.substring(original, 1, 1))
    return F.when(upper, F.upper(replacement)).when(title, F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1 << 20))).otherwise(replacement)
