"""Personal data: base patterns, and contextual extraction bootstrapped from what they find. DataFrame functions only.

Base. Each kind's pattern takes leftmost non-overlapping finds, and a check drops false ones (an address' parts over
255, a card's digits failing Luhn, too few or too many digits). Spans are in code points, end exclusive.

Bootstrap. Seeds are the base spans, and credentials in an assignment (token = "...", a further kind: secret). Candidates
are identifier-like tokens (with a digit or an @) and groups of digits that overlap no seed. A span meets up to three
patterns, each a hash of words as they stand, digits as one sign: its two words to the left; its words to the left and
to the right; its word to the left with its own shape (runs of letters and of digits as one sign each). The graph joins
patterns and instances (the spans' texts) that occur together, over all documents. In each of ROUNDS rounds, by kind,

    confidence of a pattern: sum over its occurrences of the instance's score, over their number plus SMOOTH
    support of a pattern:    its instances with a score of SURE or more
    score of an instance:    1 for a seed, else 1 - product over its trusted patterns of (1 - confidence)

and a pattern with TRUST or more of confidence and SEEDS or more of support is trusted. What a pattern itself adds to an
instance's score is left out where the score counts for that pattern, so none vouches for itself; instances found
through one pattern support others, and contexts that no seed has can so be reached. Candidates that a trusted pattern
occurs with are found identifiers, of the kind of the surest pattern. The graph's tables hold hashes and counts, are
summed before each shuffle, and Spark splits the rows of frequent patterns as skewed join partitions.

Null and empty texts have no spans; ids may be null or repeated, every row is treated by itself (ties do not arise); an
empty table gives no rows; other columns come back unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The kinds in their order, and their patterns. Java finds the same as the plain patterns, in linear time:
# a look behind skips starts inside of a run, \G allows one where the last find ended; a card's run is taken only if its
# digits are 12 to 19.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))

#: Seeds of credentials: a value of 16 signs or more that is assigned to a name of secrets.
SECRET = r"(?i)(?<=(?:token|secret|passwd|password|api_key|apikey|api-key)[\"']? ?[=:] ?[\"']?)(?<![a-z0-9+/_=-])[a-z0-9+/_-]{16,}"
NAMES = ("token", "secret", "passw", "api_key", "apikey", "api-key")
#: All kinds, in the order of ties; the base kinds first.
ALL = (*KINDS, "secret")

#: Candidates: groups of digits, and tokens of six signs or more with a digit or an @ elsewhere.
TOKEN = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z0-9@._+-]{6})[A-Za-z._+-]*[0-9@][A-Za-z0-9@._+-]*"
GROUP = r"(?<![0-9])(?<![0-9][\x20-])[0-9]+(?:[\x20-][0-9]+)+"

ROUNDS, TRUST, SURE, SMOOTH, SEEDS = 3, 0.5, 0.8, 1, 5
SPAN = "struct<start: int, ord: int, end: int>"
#: A look at so many signs beside a span, where they hold its whole words there; else at all of them.
NEAR = 64


def _finds(text: str, pattern: str) -> Column:
    """array<struct<start, end, hit>> of a pattern's finds; the texts between finds give the offsets."""
    p = F.lit(pattern)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, hit: string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    # The last gap has no find after it.
    found = F.aggregate(F.slice(pairs, F.lit(1), F.size(F.regexp_extract_all(text, p, F.lit(0)))), zero, step)["out"]
    return F.when(F.regexp_like(text, p), found).otherwise(F.array().cast("array<struct<start: int, end: int, hit: string>>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit doubles; a doubled digit over 9 counts its digit sum."""
    signs = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(signs, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _true(kind: str) -> Callable[[Column], Column]:
    """The check that a find of a kind must pass."""
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x["hit"], "\\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255)),
        "card": lambda x: _luhn(_digits(x["hit"])),
        "phone": lambda x: F.length(_digits(x["hit"])).between(9, 15),
    }[kind]


def _numbered(ord_: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(ord_).alias("ord"), x["end"].alias("end"), x["hit"].alias("hit"))


def _is(ord_: int) -> Callable[[Column], Column]:
    return lambda x: x["ord"] == ord_


def _base(text: str) -> Column:
    """Base spans by start and kind: array<struct<start, ord, end, hit>>."""
    parts = []
    for k, kind in enumerate(KINDS):
        found = F.filter(_finds(text, BASE[kind]), _true(kind))
        parts.append(F.transform(found, _numbered(k)))
    return F.array_sort(F.concat(*parts))


def _apart(x: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"]))


def _shape(hit: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(hit, "[A-Za-z]+", "a"), "[0-9]+", "0")


def _beside(text: str, x: Column) -> Column:
    """The words to the left of a span (the second one may be missing) and the word to its right, as they stand."""
    t = F.col(text)
    near = F.substring(t, F.greatest(x["start"] - (NEAR - 1), F.lit(1)), F.least(x["start"], F.lit(NEAR)))
    whole = (x["start"] <= NEAR) | near.rlike("\\s\\S+\\s+\\S+\\s*$")
    left = F.when(whole, near).otherwise(F.substring(t, F.lit(1), x["start"]))
    after = F.substring(t, x["end"] + 1, F.lit(NEAR))
    right = F.when(after.rlike("^\\s*\\S+\\s") | (F.length(after) < NEAR), after).otherwise(F.substring(t, x["end"] + 1, F.length(t)))
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    return F.struct(
        plain(F.regexp_extract(left, "(\\S+)\\s+\\S+\\s*$", 1)).alias("l2"), plain(F.regexp_extract(left, "(\\S+)\\s*$", 1)).alias("l1"), plain(F.regexp_extract(right, "^\\s*(\\S+)", 1)).alias("r1")
    )


def _edge(text: str, x: Column, ord_: Column) -> Column:
    """A span with its patterns and instance as hashes."""
    at = _beside(text, x)
    patterns = F.transform(F.array(at), lambda c: F.array(F.xxhash64(F.lit(0), c["l2"], c["l1"]), F.xxhash64(F.lit(1), c["l1"], c["r1"]), F.xxhash64(F.lit(2), c["l1"], _shape(x["hit"]))))[0]
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), ord_.alias("ord"), patterns.alias("patterns"), F.xxhash64(x["hit"]).alias("instance"))


def _secrets(text: str, base: str) -> Column:
    """Credentials in assignments, apart from base spans; most texts have no name of secrets, and are not searched."""
    named = F.lit(False)
    for n in NAMES:
        named = named | F.contains(F.lower(F.col(text)), F.lit(n))
    found = F.filter(_finds(text, SECRET), lambda x: _apart(x, F.col(base)))
    return F.transform(F.when(named, found).otherwise(F.array().cast("array<struct<start: int, end: int, hit: string>>")), _numbered(len(KINDS)))


def spans_table(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Write (k, row, base, edges): the kept columns packed, base spans, and edges of seeds and candidates."""
    text = docs.select(F.monotonically_increasing_id().alias("k"), F.struct(*[common.named(c).alias(c) for c in keep]).alias("row"), common.text_of(text_col).alias("t"))
    based = text.withColumn("base", _base("t"))
    seeded = based.withColumn("seed", F.concat("base", _secrets("t", "base")))
    grouped = seeded.withColumn("group", F.filter(_finds("t", GROUP), lambda x: (F.length(_digits(x["hit"])) >= 7) & _apart(x, F.col("seed"))))
    marked = grouped.withColumn("token", F.filter(_finds("t", TOKEN), lambda x: _apart(x, F.col("seed")) & _apart(x, F.col("group"))))
    seeds = F.transform("seed", lambda x: _edge("t", x, x["ord"]))
    others = F.transform(F.concat("token", "group"), lambda x: _edge("t", x, F.lit(-1)))
    spans = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end")))
    return common.written(marked.select("k", "row", spans.alias("base"), F.concat(seeds, others).alias("edges")), path)


def trusted_patterns(edges: DataFrame, path: str) -> DataFrame:
    """(pattern, ord, conf): the patterns that the iteration ends up trusting, each with its kind.

    edges: (ord, pattern, instance), ord -1 for candidates.
    """
    graph = common.written(edges.groupBy("pattern", "instance", "ord").agg(F.count("*").alias("n")), f"{path}/graph")
    total = graph.groupBy("pattern").agg(F.sum("n").alias("total"))
    # A row of the graph is one instance: seeds are counted exactly.
    base = graph.where("ord >= 0").groupBy("pattern", "ord").agg(F.sum("n").cast("double").alias("own"), F.count("*").alias("seeds"))
    base = common.written(base.join(total, "pattern"), f"{path}/seeds")
    open_ = graph.where("ord < 0").select("pattern", "instance", "n")
    confident = (F.col("conf") >= TRUST) & (F.col("seeds") >= SEEDS)
    scored = base.select("pattern", "ord", "seeds", (F.col("own") / (F.col("total") + SMOOTH)).alias("conf"))
    trusted = common.written(scored.where(confident).select("pattern", "ord", "conf"), f"{path}/trusted-0")
    for r in range(1, ROUNDS + 1):
        doubt = F.when(F.col("conf").isNotNull(), F.log1p(-F.least("conf", F.lit(0.999999))))
        reached = common.written(open_.join(trusted, "pattern").groupBy("instance", "ord").agg(F.sum(doubt).alias("doubt")), f"{path}/reached-{r}")
        # Every pattern of a reached instance, without what it adds itself.
        vouched = open_.join(reached, "instance").join(trusted, ["pattern", "ord"], "left")
        score = 1 - F.exp(F.col("doubt") - F.coalesce(doubt, F.lit(0.0)))
        gained = vouched.withColumn("score", score).groupBy("pattern", "ord").agg(F.sum(F.col("n") * F.col("score")).alias("gained"), F.count(F.when(F.col("score") >= SURE, True)).alias("more"))
        fresh = gained.join(base.drop("total"), ["pattern", "ord"], "full").join(total, "pattern")
        none = F.lit(0)
        conf = (F.coalesce("own", none) + F.coalesce("gained", none)) / (F.col("total") + SMOOTH)
        scored = fresh.select("pattern", "ord", (F.coalesce("seeds", none) + F.coalesce("more", none)).alias("seeds"), conf.alias("conf"))
        trusted = common.written(scored.where(confident).select("pattern", "ord", "conf"), f"{path}/trusted-{r}")
    best = trusted.groupBy("pattern").agg(F.max(F.struct("conf", -F.col("ord"))).alias("best"))
    return best.select("pattern", (-F.col("best.col2")).alias("ord"), F.col("best.conf").alias("conf"))


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row, base, spans): the kept columns packed, the base spans, and all spans; sorted arrays of (start, ord, end)."""
    path = common.workspace(docs.sparkSession)
    marked = spans_table(docs, f"{path}/spans", keep, text_col)
    edges = marked.select("k", F.explode("edges").alias("e")).select("k", "e.*")
    trusted = trusted_patterns(edges.select("ord", F.explode("patterns").alias("pattern"), "instance"), path)
    candidates = edges.where("ord < 0").select("k", "start", "end", F.explode("patterns").alias("pattern"))
    surest = candidates.join(trusted, "pattern").groupBy("k", "start", "end").agg(F.max(F.struct("conf", -F.col("ord"))).alias("best"))
    new = surest.select("k", F.struct("start", (-F.col("best.col2")).alias("ord"), "end").alias("span"))
    added = new.groupBy("k").agg(F.collect_list("span").alias("added"))
    none = F.array().cast(f"array<{SPAN}>")
    secrets = F.transform(F.filter("edges", lambda e: e["ord"] == len(KINDS)), lambda e: F.struct(e["start"].alias("start"), e["ord"].alias("ord"), e["end"].alias("end")))
    whole = marked.select("k", "row", "base", secrets.cast(f"array<{SPAN}>").alias("secrets")).join(added, "k", "left")
    return whole.select("row", "base", F.array_sort(F.concat("base", "secrets", F.coalesce("added", none).cast(f"array<{SPAN}>"))).alias("spans"))


def written_spans(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; spans that overlap make one."""
    found = find(docs, docs.columns, text_col).withColumn("t", F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = x["start"] >= acc["at"]
        piece = F.concat(F.substring(F.col("t"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in ALL]), x["ord"] + 1)), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    merged = F.aggregate("spans", start, step)
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(merged["out"], ""), F.substring(F.col("t"), merged["at"] + 1, F.length("t")))).otherwise(F.col("row")[text_col])
    return found.select(*[(text.alias(c) if c == text_col else F.col("row")[c].alias(c)) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    found = found.withColumn("doc_id", F.col("row")["doc_id"])
    more = F.size(F.filter("spans", _is(len(KINDS)))).cast("long").alias("n_secret")
    return found.select("doc_id", *counts, F.sha2(written_spans("base"), 256).alias("base_sha256"), written_spans("spans").alias("spans"), more)
