"""Queries of the greedy merge, of streaming jobs' plans and of reference cycles, with SQL written apart from theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge, references
from ..streaming import events, state
from . import duck, shared


def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared._views(spark, sf_dir, "issues")
    issues = spark.sql(f"WITH {shared._tables('issues', '', ', 0')}\nSELECT doc_id, ord, category, rule_name, flagged, sent_idx, start_pos, end_pos FROM issues")
    return merge.merge(issues)


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job's plan over the same table read as a batch."""
    out = events.tumbling(spark.read.schema(events.SCHEMA).parquet(f"{sf_dir}/events.parquet"))
    return out.select(F.col("window.start").cast("string").alias("window_start"), "event_type", "n", (F.round(F.col("value") * 1e4, 0) / 1e4).alias("value"))


def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.sliding(spark.read.schema(events.SCHEMA).parquet(f"{sf_dir}/events.parquet"))
    return out.select(F.col("window.start").cast("string").alias("window_start"), "event_type", "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.sessions(spark.read.schema(events.SCHEMA).parquet(f"{sf_dir}/events.parquet"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def ended_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job of keyed state over the same table read as a batch: sessions that a later event has ended (a batch runs no timers)."""
    state.use_rocksdb(spark)
    rows = spark.read.schema(events.SCHEMA).parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_type") == "error", "dismissed").when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "signup", "resolved").when(F.col("event_type") == "view", "open")
    told = rows.select("event_id", "ts", "user_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("issue"), status.alias("status"))
    return state.sessions(told, 24 * state.TTL)


def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches between blank lines that say anything, one at least."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.greatest(F.lit(1), F.size(parts)).alias("paragraphs"))


def syllables_by_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables by the turns from other signs to vowels, less a silent e, one at least; by length of words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    word = F.lower("token")
    turns = F.size(F.regexp_extract_all(F.concat(F.lit("-"), word), F.lit("[^aeiouy][aeiouy]"), F.lit(0)))
    count = F.greatest(F.lit(1), turns - F.when(word.rlike("[^aeiouy]e$") & (turns > 1), 1).otherwise(0))
    return T.tokens(T.sentences(docs)).groupBy(F.length("token").alias("letters")).agg(F.count("*").alias("words"), F.sum(count).alias("syllables"))


#: Words of talking to a reader, and of talking about one.
TO_READER, OF_READER = ("you", "your", "yours"), ("user", "users", "customer", "reader", "administrator")


def reader_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns that speak to a reader and of one at once, or either: the sets of such words in each."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    prose = spark.createDataFrame([(-1, 0, "user", "You are the user, and your users are users."), (-2, 0, "user", "The reader reads."), (-3, 0, "user", "None.")], "conv_id long, turn long, role string, text string")
    said = F.array_distinct(F.transform(T.words("text"), lambda w: F.lower(w)))
    both = turns.unionByName(prose).withColumns({"to": F.array_intersect(said, F.array(*map(F.lit, TO_READER))), "of": F.array_intersect(said, F.array(*map(F.lit, OF_READER)))})
    found = both.where(F.arrays_overlap(said, F.array(*map(F.lit, TO_READER + OF_READER))))
    return found.select("conv_id", "turn", F.array_join(F.array_sort("to"), ",").alias("to_reader"), F.array_join(F.array_sort("of"), ",").alias("of_reader"), ((F.size("to") > 0) & (F.size("of") > 0)).alias("mixed"))


def reference_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose links lead back to them in up to four steps; a link leads to the pages whose title opens with its word."""
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages")
    edges = spark.sql(f"WITH {shared.LINKS} SELECT concat('/', lower(regexp_extract(p.html, '<h1>([A-Za-z]+)', 1))) AS source, e.target FROM edges AS e JOIN pages AS p ON p.page_id = e.source")
    return references.cycles(edges.where("source <> '/'"))


def greedy_merge_sql() -> str:
    """The fold as a reduction of one-element lists."""
    head = shared.sql("issue_ids")
    head = head[: head.rindex("SELECT doc_id, ord, sha256")]
    broad = "CASE category " + " ".join(f"WHEN {duck.lit(a)} THEN {duck.lit(b)}" for a, b in merge.BROAD.items()) + " ELSE category END"
    clash = "a.t = y[1].t OR (2 * (least(a.e, y[1].e) - greatest(a.s, y[1].s)) > least(a.e - a.s, y[1].e - y[1].s) AND least(a.e - a.s, y[1].e - y[1].s) > 0)"
    return f"""{head} SELECT doc_id, kept.ord AS ord, kept.category AS category, kept.rule_name AS rule_name, kept.flagged AS flagged, sent_idx, kept.s AS start_pos, kept.e AS end_pos FROM (
      SELECT doc_id, sent_idx, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda a: {clash})) > 0 THEN acc ELSE list_concat(acc, y) END)) AS kept FROM (
        SELECT doc_id, sent_idx, {broad} AS grp, list({{'ord': ord, 't': lower(trim(flagged)), 's': start_pos, 'e': end_pos, 'category': category, 'rule_name': rule_name, 'flagged': flagged}} ORDER BY ord) AS l
        FROM issues GROUP BY doc_id, sent_idx, grp))"""


_SAID = f"list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{duck.WORD}'), lambda w: lower(w)))"
SQL = {
    "paragraph_counts": "SELECT doc_id, greatest(1, len(list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: trim(x) <> '')))::INTEGER AS paragraphs FROM documents",
    "syllables_by_turns": f"""WITH {duck.TOKENS}, t AS (SELECT length(token) AS letters, lower(token) AS w, len(regexp_extract_all('-' || lower(token), '[^aeiouy][aeiouy]')) AS n FROM tokens)
SELECT letters::INTEGER AS letters, count(*) AS words, sum(greatest(1, n - CASE WHEN n > 1 AND regexp_matches(w, '[^aeiouy]e$') THEN 1 ELSE 0 END))::BIGINT AS syllables FROM t GROUP BY letters""",
    "reader_words": f"""WITH c AS (SELECT conv_id, turn, text FROM conversations UNION ALL VALUES (-1, 0, 'You are the user, and your users are users.'), (-2, 0, 'The reader reads.'), (-3, 0, 'None.')),
s AS (SELECT conv_id, turn, list_sort(list_filter({_SAID}, lambda w: w IN {TO_READER})) AS t, list_sort(list_filter({_SAID}, lambda w: w IN {OF_READER})) AS o FROM c)
SELECT conv_id, turn, array_to_string(t, ',') AS to_reader, array_to_string(o, ',') AS of_reader, len(t) > 0 AND len(o) > 0 AS mixed FROM s WHERE len(t) + len(o) > 0""",
    "ended_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS issue, CASE event_type WHEN 'error' THEN 'dismissed' WHEN 'purchase' THEN 'accepted' WHEN 'signup' THEN 'resolved' WHEN 'view' THEN 'open' END AS status FROM events),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < 86400000 THEN 0 ELSE 1 END AS fresh FROM e),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
l AS (SELECT user_id, run, issue, arg_max(status, ms * 1000000 + event_id) AS status FROM r WHERE status IS NOT NULL GROUP BY ALL)
SELECT user_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS events, coalesce(any_value(issues), 0) AS issues, coalesce(any_value(settled), 0) AS settled
FROM r LEFT JOIN (SELECT user_id, run, count(*) AS issues, count(*) FILTER (WHERE status <> 'open') AS settled FROM l GROUP BY ALL) USING (user_id, run) GROUP BY user_id, run QUALIFY run < max(run) OVER (PARTITION BY user_id)""",
    "greedy_merge": greedy_merge_sql(),
    "sliding_events": "SELECT CAST(time_bucket(INTERVAL 15 MINUTE, ts) - off AS VARCHAR(30)) AS window_start, event_type, count(*) AS n FROM events, (VALUES (INTERVAL 0 MINUTE), (INTERVAL 15 MINUTE), (INTERVAL 30 MINUTE), (INTERVAL 45 MINUTE)) AS o(off) GROUP BY 1, 2",
    "hourly_events": "SELECT CAST(date_trunc('hour', ts) AS VARCHAR(30)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "session_windows": "SELECT user_id, CAST(sum(CASE WHEN was IS NULL OR ts - was >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) AS BIGINT) AS sessions, count(*) AS events FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events) GROUP BY user_id",
}


def queries() -> dict:
    return {f.__name__: f for f in (paragraph_counts, syllables_by_turns, reader_words, greedy_merge, hourly_events, sliding_events, session_windows, ended_sessions, reference_cycles)}


def oracle_sql() -> dict[str, str]:
    return SQL
