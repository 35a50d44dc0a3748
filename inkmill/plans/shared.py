"""Relational queries in one SQL text for Spark and DuckDB, over base views that each engine builds in its own way.

Spark's views come from DataFrame operators (functions.text, sources.html); DuckDB's are the CTEs of plans.duck. The
text between keeps to what both read; `_duck` renames the few functions whose names differ.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..operators import lexicons, references
from . import duck
from . import rules as R

RENAMED = (("regexp_like", "regexp_matches"), ("bround", "round_even"), ("size", "len"), ("collect_list", "list"), ("array_join", "array_to_string"), ("explode", "unnest"))

#: Each guide with its categories, and how many rules stand behind it.
GUIDES = "(VALUES ('house', 'style', 50), ('house', 'grammar', 50), ('terms', 'word-usage', 25), ('accessible', 'punctuation', 15), ('modular', 'structure', 20), ('modular', 'references', 20)) AS g(guide, category, rules)"
#: Rules whose finds stand for those of an outside checker and of a model, the tiers below our own. Both are providers that give nothing by default.
TIERS = "(VALUES ('spelling', 'checker'), ('compound_words', 'checker'), ('punctuation_and_symbols', 'checker'), ('exclamation_points', 'checker'), ('tone', 'model'), ('simple_words', 'model'), ('conversational_style', 'model'), ('second_person', 'model')) AS t(rule_name, source)"
#: Decisions of an earlier review, by rule and flagged text; all other issues are open.
DECISIONS = "(VALUES ('exclamation_points', '!!', 'dismissed'), ('abbreviations', 'e.g.', 'accepted'), ('simple_words', 'the fact that', 'dismissed'), ('spelling', 'grey', 'dismissed')) AS d(rule_name, flagged, status)"
#: The profile's finds with their spans, tier, status, and confidence by kind of rule.
ISSUES = f"""
issues AS (
  SELECT o.doc_id, CAST(o.ord AS INT) AS ord, coalesce(t.source, 'rules') AS source, o.category, o.rule_name, o.flagged, o.severity, o.sent_idx, o.start_pos, o.end_pos,
         coalesce(g.guide, 'house') AS guide, coalesce(d.status, 'open') AS status, CASE WHEN o.category = 'word-usage' THEN 9e-1 WHEN t.source = 'model' THEN 5e-1 WHEN t.source = 'checker' THEN 7e-1 ELSE 8e-1 END AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, start_pos, end_pos, rule_name, severity) AS ord FROM raw_issues) AS o
  LEFT JOIN {TIERS} ON t.rule_name = o.rule_name LEFT JOIN {DECISIONS} ON d.rule_name = o.rule_name AND d.flagged = lower(o.flagged) LEFT JOIN (SELECT guide, category FROM {GUIDES}) AS g ON g.category = o.category
)"""
RANK = "CASE {c}.source WHEN 'rules' THEN 1 WHEN 'checker' THEN 2 ELSE 3 END"

SENTENCE_WORDS = "sentence_words AS (SELECT doc_id, sent_idx, sentence, CAST(size(regexp_extract_all(sentence, '[^ ]+'{all})) AS INT) AS words FROM sentences)"
STATS = """
doc_words AS (SELECT doc_id, count(*) AS words, count(DISTINCT lower(token)) AS unique_words, CAST(sum(length(token)) AS BIGINT) AS letters, CAST(sum(syllables) AS BIGINT) AS syllables,
              CAST(sum(CASE WHEN syllables >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS complex FROM token_syllables GROUP BY doc_id),
doc_sentences AS (SELECT doc_id, count(*) AS sentences FROM sentences GROUP BY doc_id),
stats AS (SELECT s.doc_id, s.sentences, coalesce(w.words, 0) AS words, coalesce(w.unique_words, 0) AS unique_words, coalesce(w.letters, 0) AS letters, coalesce(w.syllables, 0) AS syllables, coalesce(w.complex, 0) AS complex
          FROM doc_sentences AS s LEFT JOIN doc_words AS w ON s.doc_id = w.doc_id)"""
SCORES = """
penalties AS (SELECT doc_id, sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * CASE category WHEN 'grammar' THEN 1.5 WHEN 'structure' THEN 1.3 WHEN 'word-usage' THEN 1.2 WHEN 'punctuation' THEN 0.8 ELSE 1.0 END) AS penalty,
              count(*) AS open_issues FROM issues WHERE status = 'open' GROUP BY doc_id),
scores AS (SELECT t.doc_id, t.words, coalesce(p.open_issues, 0) AS open_issues, round(coalesce(CAST(p.penalty AS DOUBLE), 0), 4) AS penalty,
           CAST(greatest(30, bround(100 - coalesce(CAST(p.penalty AS DOUBLE), 0) / CASE WHEN t.words <= 100 THEN 1 ELSE 1 + log10(t.words / 100.0) END, 0)) AS INT) AS score
           FROM stats AS t LEFT JOIN penalties AS p ON t.doc_id = p.doc_id)"""
#: Block runs: consecutive blocks of a kind, by gaps and islands.
LIFECYCLE = """
status_log AS (SELECT event_id, user_id AS session_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS issue_id, CASE event_type WHEN 'error' THEN 'dismissed' WHEN 'purchase' THEN 'accepted' WHEN 'signup' THEN 'resolved' ELSE 'open' END AS status, event_type AS rule_type, value, ts FROM events)"""

NEEDS = {
    "sentence_words": ("sentences",),
    "token_syllables": ("tokens",),
    "raw": ("sentence_words", "tokens"),
}

#: "Full Name (ABC)", the last one of a document wins.
DEFINITIONS = """
definitions AS (SELECT doc_id, sent, regexp_extract(hit, '[(]([A-Z]{2,6})[)]$', 1) AS acronym, regexp_extract(hit, '^(.*[a-z]) [(]', 1) AS full_name
  FROM (SELECT doc_id, sent_idx AS sent, explode(regexp_extract_all(sentence, '((?:[A-Z][a-z]+ ){1,6}[(][A-Z]{2,6}[)])', 1)) AS hit FROM sentences WHERE sentence LIKE '%(%') AS h)"""
#: Words of the built-in lexicon's right forms: the registry of known terms.
KNOWN = "(VALUES " + ", ".join(f"({duck.lit(w)})" for w in sorted({w.lower() for r in lexicons.rows() for w in r[2].split()})) + ") AS v(known)"

#: Names of places with words that they are misused beside.
PLACES = "(VALUES ('holland', 'country'), ('holland', 'kingdom'), ('england', 'kingdom'), ('britain', 'ireland'), ('america', 'continent'), ('america', 'country'), ('scandinavia', 'finland')) AS p(place, context)"

#: Queries over the finds in texts of every language: rules and word lists about English are not held back from the others there.
EVERY_LANGUAGE = {"merge_block_and_full", "label_scores", "carried_status"}

# name: (base views, common tables, select)
Q: dict[str, tuple[str, str, str]] = {}


def q(name: str, base: str, select: str, tables: str = "") -> None:
    Q[name] = (base, tables, select)


# -- rows and projections
q("sentence_length", "text", "SELECT doc_id, sent_idx, words, CASE WHEN words > 40 THEN 'high' WHEN words > 30 THEN 'medium' ELSE 'low' END AS severity FROM sentence_words WHERE words > 25 AND length(sentence) - length(replace(sentence, '/', '')) < 4 AND length(sentence) - length(replace(sentence, '`', '')) < 4")
q("repeated_words", "text", "SELECT doc_id, sent_idx, pos, token FROM (SELECT doc_id, sent_idx, pos, token, lag(lower(token)) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos) AS was FROM tokens) AS t WHERE was = lower(token) AND lower(token) NOT IN ('that', 'had')")
q("document_stats", "text", "SELECT doc_id, sentences, words, unique_words, round(unique_words / CAST(CASE WHEN words = 0 THEN 1 ELSE words END AS DOUBLE), 4) AS ttr, round(words / CAST(sentences AS DOUBLE), 2) AS avg_words, round(syllables / CAST(CASE WHEN words = 0 THEN 1 ELSE words END AS DOUBLE), 2) AS avg_syllables FROM stats", STATS)
q("readability", "text", """SELECT doc_id,
  CASE WHEN words < 3 THEN 0.0 ELSE round(206.835 - 1.015 * words / sentences - 84.6 * syllables / words, 6) END AS flesch,
  CASE WHEN words < 3 THEN 0.0 ELSE round(0.39 * words / sentences + 11.8 * syllables / words - 15.59, 6) END AS flesch_kincaid,
  CASE WHEN words < 3 THEN 0.0 ELSE round(0.4 * (CAST(words AS DOUBLE) / sentences + 100.0 * complex / words), 6) END AS gunning_fog,
  CASE WHEN words < 3 THEN 0.0 ELSE round(0.0588 * (100.0 * letters / words) - 0.296 * (100.0 * sentences / words) - 15.8, 6) END AS coleman_liau,
  CASE WHEN words < 3 THEN 0.0 ELSE round(1.043 * sqrt(complex * 30.0 / sentences) + 3.1291, 6) END AS smog,
  CASE WHEN words < 3 THEN 0.0 ELSE round(4.71 * letters / words + 0.5 * words / sentences - 21.43, 6) END AS ari FROM (SELECT doc_id, CAST(words AS DOUBLE) AS words, CAST(sentences AS DOUBLE) AS sentences, CAST(syllables AS DOUBLE) AS syllables, CAST(letters AS DOUBLE) AS letters, CAST(complex AS DOUBLE) AS complex FROM stats) AS d""", STATS)
q("readability_bands", "text", """SELECT band, count(*) AS docs FROM (SELECT doc_id, CASE WHEN f >= 90 THEN 'very easy' WHEN f >= 80 THEN 'easy' WHEN f >= 70 THEN 'fairly easy' WHEN f >= 60 THEN 'standard' WHEN f >= 50 THEN 'fairly hard' WHEN f >= 30 THEN 'hard' ELSE 'very hard' END AS band
  FROM (SELECT doc_id, round(206.835 - 1.015 * words / CAST(sentences AS DOUBLE) - 84.6 * syllables / CAST(words AS DOUBLE), 6) AS f FROM stats WHERE words >= 3) AS a) AS b GROUP BY band""", STATS)
q("grade_levels", "text", "SELECT doc_id, grade, CASE WHEN g < 6 THEN 'elementary' WHEN g < 9 THEN 'middle' WHEN g < 13 THEN 'high school' ELSE 'college' END AS level, g BETWEEN 9 AND 11 AS on_target FROM (SELECT doc_id, round(0.39 * words / CAST(sentences AS DOUBLE) + 11.8 * syllables / CAST(words AS DOUBLE) - 15.59, 1) AS grade, round(0.39 * words / CAST(sentences AS DOUBLE) + 11.8 * syllables / CAST(words AS DOUBLE) - 15.59, 6) AS g FROM stats WHERE words >= 3) AS a", STATS)
q("reading_time", "text", "SELECT doc_id, greatest(1, CAST(floor(words / 200.0) AS INT)) AS minutes, CASE WHEN words >= 12000 THEN concat(CAST(CAST(floor(words / 12000.0) AS INT) AS VARCHAR(20)), 'h ', CAST(CAST(floor(words / 200.0) AS INT) % 60 AS VARCHAR(20)), 'm') ELSE concat(CAST(greatest(1, CAST(floor(words / 200.0) AS INT)) AS VARCHAR(20)), 'm') END AS shown FROM stats", STATS)
q("sentence_statistics", "text", "SELECT doc_id, min(words) AS shortest, max(words) AS longest, count(*) AS n, round(CASE WHEN avg(words) > 0 THEN stddev_pop(words) / avg(words) ELSE 0 END, 6) AS variation FROM sentence_words GROUP BY doc_id")
q("sentence_median", "text", "SELECT doc_id, words AS median_words FROM (SELECT doc_id, words, row_number() OVER (PARTITION BY doc_id ORDER BY words, sent_idx) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM sentence_words) AS t WHERE r = CAST(floor(n / 2.0) AS INT) + 1")
q("sentence_variety", "text", "SELECT doc_id, CAST(least(4, floor(words / 10.0)) AS INT) AS bucket, count(*) AS n FROM sentence_words GROUP BY 1, 2")
q("complexity", "text", "SELECT doc_id, round(avg(words / 20e0 + 0.1e0 * (length(sentence) - length(replace(sentence, ',', ''))) + 0.2e0 * (length(sentence) - length(replace(sentence, ';', '')))), 6) AS complexity FROM sentence_words GROUP BY doc_id")
q("passive_share", "text", "SELECT doc_id, round(avg(CASE WHEN regexp_like(lower(sentence), '(^|[^a-z])(is|are|was|were|be|been|being) +[a-z]+(ed|en)($|[^a-z])') THEN 1e0 ELSE 0e0 END), 6) AS passive FROM sentences GROUP BY doc_id")
q("word_statistics", "text", "SELECT doc_id, round(avg(length(token)), 6) AS avg_length, round(avg(syllables), 6) AS avg_syllables, round(avg(CASE WHEN syllables >= 3 THEN 100e0 ELSE 0e0 END), 6) AS complex_percent FROM token_syllables GROUP BY doc_id")
q("top_words", "text", "SELECT doc_id, word, n, CAST(r AS INT) AS rank FROM (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS r FROM (SELECT doc_id, lower(token) AS word, count(*) AS n, min(sent_idx * 100000 + pos) AS first_at FROM tokens GROUP BY doc_id, lower(token)) AS c) AS t WHERE r <= 10")
q("voice_and_adverbs", "text", "SELECT doc_id, count(CASE WHEN lower(token) IN ('i', 'we', 'us', 'our', 'my') THEN 1 END) AS first_person, count(CASE WHEN lower(token) IN ('you', 'your') THEN 1 END) AS second_person, count(CASE WHEN lower(token) IN ('he', 'she', 'it', 'they', 'their') THEN 1 END) AS third_person, round(100e0 * count(CASE WHEN regexp_like(lower(token), '[a-z]{2,}ly$') THEN 1 END) / count(*), 6) AS adverb_percent FROM tokens GROUP BY doc_id")
q("technical_predicates", "text", "SELECT doc_id, sent_idx, regexp_like(sentence, 'https?://') AS has_url, regexp_like(sentence, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.]') AS has_address, regexp_like(sentence, '[a-z]_[a-z]') AS has_snake FROM sentences WHERE regexp_like(sentence, 'https?://|[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.]|[a-z]_[a-z]')")
q("context_sentences", "text", "SELECT doc_id, sent_idx, CAST(sum(length(sentence)) OVER w AS BIGINT) AS context_chars, count(*) OVER w AS context_sentences FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
q("acronyms", "text", "SELECT doc_id, acronym, max_by(full_name, sent) AS full_name, count(*) AS n FROM definitions GROUP BY doc_id, acronym", "{definitions}")
q("undefined_acronyms", "text", "SELECT a.doc_id, a.acronym, a.first_at FROM (SELECT doc_id, token AS acronym, min(sent_idx) AS first_at FROM tokens WHERE regexp_like(token, '^[A-Z]{3,5}$') GROUP BY doc_id, token) AS a LEFT ANTI JOIN (SELECT doc_id, acronym FROM definitions) AS d ON a.doc_id = d.doc_id AND a.acronym = d.acronym LEFT ANTI JOIN (SELECT known FROM (VALUES ('URL'), ('HTTP'), ('HTML'), ('JSON'), ('XML')) AS k(known)) AS k ON a.acronym = k.known", "{definitions}")
q("expletive_unions", "text", "SELECT doc_id, sent_idx, 'there' AS opening FROM sentences WHERE regexp_like(lower(sentence), '^there (is|are|was|were|has|have) ') UNION SELECT doc_id, sent_idx, 'it' FROM sentences WHERE regexp_like(lower(sentence), '^it (is|was|has been) ') UNION SELECT doc_id, sent_idx, 'here' FROM sentences WHERE regexp_like(lower(sentence), '^here (is|are) ')")
q("new_headwords", "text", "SELECT term, count(*) AS n FROM (SELECT lower(token) AS term FROM tokens) AS t LEFT ANTI JOIN (SELECT known FROM {known}) AS k ON t.term = k.known GROUP BY term")
q("term_coverage", "text", "SELECT letter, count(*) AS terms, count(known) AS covered, round(100e0 * count(known) / count(*), 4) AS percent FROM (SELECT substr(term, 1, 1) AS letter, term, known FROM (SELECT DISTINCT lower(token) AS term FROM tokens) AS t LEFT JOIN (SELECT known FROM {known}) AS k ON t.term = k.known) AS c GROUP BY ROLLUP (letter)")
q("proximity", "text", f"SELECT a.doc_id, a.sent_idx, a.pos AS pos_a, b.pos AS pos_b, p.place, p.context FROM {PLACES} JOIN tokens AS a ON lower(a.token) = p.place JOIN tokens AS b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND lower(b.token) = p.context AND abs(a.pos - b.pos) <= 5")

# -- issues: filters, dedup, merge, score, compliance, report
q("scorable_issues", "issues", "SELECT doc_id, ord, rule_name, severity FROM issues WHERE status = 'open'")
q("confident_issues", "issues", "SELECT doc_id, ord, rule_name, confidence FROM issues WHERE confidence >= 0.5")
q("sorted_issues", "issues", "SELECT doc_id, ord, sent_idx, start_pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, start_pos, ord) AS INT) AS place FROM issues")
q("dedup_block", "issues", "SELECT doc_id, ord, rule_name, flagged FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_name, lower(flagged) ORDER BY ord) AS r FROM issues) AS t WHERE r = 1")
q("dedup_full", "issues", "SELECT doc_id, ord, rule_name, flagged, sent_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_name, lower(flagged), sent_idx ORDER BY ord) AS r FROM issues) AS t WHERE r = 1")
q("merge_block_and_full", "issues", "SELECT doc_id, ord, rule_name, flagged, 'block' AS pass FROM block_issues UNION ALL SELECT f.doc_id, f.ord, f.rule_name, f.flagged, 'full' FROM (SELECT * FROM issues WHERE source <> 'model') AS f LEFT ANTI JOIN block_issues AS b ON f.doc_id = b.doc_id AND f.rule_name = b.rule_name AND lower(f.flagged) = lower(b.flagged)",
  "block_issues AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_name, lower(flagged) ORDER BY ord) AS r FROM issues WHERE source <> 'checker') AS t WHERE r = 1)")
q("merge_tiers", "issues", f"""SELECT l.doc_id, l.ord, l.source, l.rule_name FROM issues AS l LEFT ANTI JOIN issues AS h
  ON l.doc_id = h.doc_id AND l.sent_idx = h.sent_idx AND {RANK.format(c='l')} > {RANK.format(c='h')}
  AND (lower(l.flagged) = lower(h.flagged) OR (least(l.end_pos, h.end_pos) - greatest(l.start_pos, h.start_pos)) * 2 > least(l.end_pos - l.start_pos, h.end_pos - h.start_pos))""")
q("span_overlaps", "issues", "SELECT a.doc_id, a.ord AS ord_a, b.ord AS ord_b FROM issues AS a JOIN issues AS b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.ord < b.ord AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos AND (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) * 5 > least(a.end_pos - a.start_pos, b.end_pos - b.start_pos) * 4")
q("priority_suppression", "issues", "SELECT a.doc_id, a.ord FROM issues AS a LEFT ANTI JOIN issues AS b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos AND CASE b.severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END > CASE a.severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END")
q("judge_keeps", "issues", "SELECT i.doc_id, i.ord, i.batch FROM (SELECT doc_id, ord, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) / 25.0) AS INT) AS batch FROM issues) AS i LEFT SEMI JOIN (SELECT doc_id, ord FROM issues WHERE source <> 'model' OR severity <> 'low') AS k ON i.doc_id = k.doc_id AND i.ord = k.ord")
q("examples_per_rule", "issues", "SELECT rule_name, doc_id, ord FROM (SELECT rule_name, doc_id, ord, row_number() OVER (PARTITION BY rule_name ORDER BY doc_id, ord) AS r FROM issues) AS t WHERE r <= 3")
q("citations", "issues", f"SELECT i.doc_id, i.ord, g.guide, g.rules FROM issues AS i LEFT JOIN {GUIDES} ON i.category = g.category")
q("penalty", "issues", "SELECT doc_id, round(CAST(penalty AS DOUBLE), 4) AS penalty, open_issues FROM penalties", STATS + "," + SCORES)
q("document_scores", "issues", "SELECT doc_id, words, open_issues, penalty, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Needs Work' ELSE 'Poor' END AS label FROM scores", STATS + "," + SCORES)
q("score_distribution", "issues", "SELECT CASE WHEN score >= 90 THEN 'green' WHEN score >= 75 THEN 'blue' WHEN score >= 60 THEN 'orange' ELSE 'red' END AS colour, count(*) AS docs, min(score) AS lowest, max(score) AS highest FROM scores GROUP BY 1", STATS + "," + SCORES)
q("category_counts", "issues", "SELECT doc_id, category, count(*) AS n FROM issues GROUP BY doc_id, category")
q("category_severity_cube", "issues", "SELECT category, severity, count(*) AS n FROM issues GROUP BY CUBE (category, severity)")
q("error_metrics", "issues", "SELECT rule_name, severity, count(*) AS n, round(avg(confidence), 6) AS confidence FROM issues GROUP BY GROUPING SETS ((rule_name), (severity), ())")
q("severity_pivot", "issues", "SELECT doc_id, count(CASE WHEN severity = 'high' THEN 1 END) AS high, count(CASE WHEN severity = 'medium' THEN 1 END) AS medium, count(CASE WHEN severity = 'low' THEN 1 END) AS low FROM issues GROUP BY doc_id HAVING count(*) > 3")
q("compliance_by_citation", "issues", "SELECT t.doc_id, t.guide, round(greatest(0e0, 1e0 - coalesce(i.n, 0) / CAST(greatest(t.words, 1) AS DOUBLE)), 4) AS compliance FROM (SELECT doc_id, words, explode(split('house,terms,accessible,modular', ',')) AS guide FROM stats) AS t LEFT JOIN (SELECT doc_id, guide, count(*) AS n FROM issues WHERE status = 'open' GROUP BY doc_id, guide) AS i ON i.doc_id = t.doc_id AND i.guide = t.guide", STATS)
q("compliance_by_category", "issues", f"SELECT i.doc_id, g.guide, round(greatest(0e0, 1e0 - sum(i.n) / CAST(max(g.rules) AS DOUBLE)), 4) AS compliance FROM (SELECT doc_id, category, count(*) AS n FROM issues GROUP BY doc_id, category) AS i JOIN {GUIDES} ON i.category = g.category GROUP BY i.doc_id, g.guide")
q("priority_actions", "issues", "SELECT doc_id, rule_name, n, CAST(r AS INT) AS place FROM (SELECT doc_id, rule_name, n, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, rule_name) AS r FROM (SELECT doc_id, rule_name, count(*) AS n, sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS weight FROM issues WHERE status = 'open' GROUP BY doc_id, rule_name) AS t) AS p WHERE r <= 5")
q("excerpt_budget", "issues", "SELECT doc_id, rule_name, tokens FROM (SELECT doc_id, rule_name, tokens, sum(tokens) OVER (PARTITION BY doc_id ORDER BY n DESC, rule_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM (SELECT doc_id, rule_name, count(*) AS n, CAST(ceil(0.25 * sum(length(flagged))) AS INT) AS tokens FROM issues GROUP BY doc_id, rule_name) AS t) AS u WHERE used <= 40")
q("overall_metrics", "issues", "SELECT s.doc_id, round(0.25 * s.score + 0.20 * least(100.0, 1000.0 * t.unique_words / CAST(greatest(t.words, 1) AS DOUBLE) / 10) + 0.15 * greatest(0.0, 100.0 - s.open_issues), 4) AS overall FROM scores AS s JOIN stats AS t ON s.doc_id = t.doc_id", STATS + "," + SCORES)
q("label_scores", "issues", "SELECT l.quality, count(*) AS docs, round(avg(s.score), 6) AS avg_score FROM scores AS s JOIN labels AS l ON s.doc_id = l.doc_id GROUP BY l.quality", STATS + "," + SCORES)
q("carried_status", "issues", f"SELECT n.doc_id, n.ord, n.rule_name, coalesce(d.status, 'open') AS status FROM issues AS n LEFT JOIN {DECISIONS} ON d.rule_name = n.rule_name AND d.flagged = lower(n.flagged)")
q("issue_ids", "issues", "SELECT doc_id, ord, sha2(concat(CAST(doc_id AS VARCHAR(20)), '|', rule_name, '|', CAST(start_pos AS VARCHAR(20)), '|', CAST(end_pos AS VARCHAR(20))), 256) AS issue_id FROM issues")

# -- blocks: document-level state machines as windows
W = "(PARTITION BY doc_id ORDER BY block_idx)"
q("html_blocks", "blocks", "SELECT doc_id, block_idx, block_type, level, content FROM blocks")
q("block_type_counts", "blocks", "SELECT doc_id, block_type, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM blocks GROUP BY doc_id, block_type")
q("heading_level_skip", "blocks", f"SELECT doc_id, block_idx, level, was FROM (SELECT doc_id, block_idx, level, lag(level) OVER {W} AS was FROM blocks WHERE block_type = 'heading') AS t WHERE level > was + 1")
q("empty_section", "blocks", f"SELECT doc_id, block_idx, content FROM (SELECT doc_id, block_idx, block_type, content, lead(block_type) OVER {W} AS next_type FROM blocks) AS t WHERE block_type = 'heading' AND next_type = 'heading'")
ISLANDS = "(SELECT doc_id, block_idx, {kind} AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - row_number() OVER (PARTITION BY doc_id, {kind} ORDER BY block_idx) AS island FROM blocks) AS t"
q("procedure_step_count", "blocks", f"SELECT doc_id, min(block_idx) AS first_block, count(*) AS steps FROM {ISLANDS.format(kind="block_type = 'list_item_ordered'")} WHERE hit GROUP BY doc_id, island HAVING count(*) > 10")
q("admonition_stacking", "blocks", f"SELECT doc_id, min(block_idx) AS first_block, count(*) AS run FROM {ISLANDS.format(kind="block_type = 'admonition'")} WHERE hit GROUP BY doc_id, island HAVING count(*) >= 2")
q("admonition_placement", "blocks", """SELECT doc_id, min(block_idx) AS block_idx FROM (SELECT doc_id, block_idx, block_type, max(CASE WHEN block_type = 'heading' THEN block_idx END) OVER w AS heading, max(CASE WHEN block_type = 'paragraph' THEN block_idx END) OVER w AS paragraph, count(CASE WHEN block_type = 'heading' THEN 1 END) OVER w AS headings
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING)) AS t WHERE block_type = 'admonition' AND (headings = 0 OR (headings = 1 AND coalesce(paragraph, -1) < heading)) GROUP BY doc_id""")
q("prerequisites_position", "blocks", "SELECT doc_id, prereq, steps FROM (SELECT doc_id, min(CASE WHEN block_type = 'heading' AND lower(content) LIKE 'prerequisite%' THEN block_idx END) AS prereq, min(CASE WHEN block_type = 'heading' AND lower(content) LIKE 'procedure%' THEN block_idx END) AS steps FROM blocks GROUP BY doc_id) AS t WHERE prereq > steps")
q("verification_section", "blocks", "SELECT doc_id FROM blocks GROUP BY doc_id HAVING max(CASE WHEN block_type = 'list_item_ordered' OR (block_type = 'heading' AND lower(content) LIKE 'procedure%') THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN block_type = 'heading' AND lower(content) LIKE 'verif%' THEN 1 ELSE 0 END) = 0")
q("single_step_procedure", "blocks", f"SELECT doc_id, min(block_idx) AS block_idx FROM {ISLANDS.format(kind="block_type = 'list_item_ordered'")} WHERE hit GROUP BY doc_id, island HAVING count(*) = 1")
q("where_list", "blocks", "SELECT doc_id, block_idx, content FROM (SELECT doc_id, block_idx, block_type, content, max(CASE WHEN block_type <> 'list_item_unordered' THEN block_idx END) OVER w AS last_other, max(CASE WHEN block_type = 'paragraph' AND lower(content) = 'where:' THEN block_idx END) OVER w AS last_where FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING)) AS t WHERE block_type = 'list_item_unordered' AND last_where = last_other AND regexp_like(content, '^`[^`]+`:? Specify ')")
q("abstracts", "blocks", "SELECT b.doc_id, min_by(b.content, b.block_idx) AS abstract FROM blocks AS b JOIN (SELECT doc_id, min(block_idx) AS h FROM blocks WHERE block_type = 'heading' GROUP BY doc_id) AS f ON b.doc_id = f.doc_id WHERE b.block_type = 'paragraph' AND b.block_idx > f.h GROUP BY b.doc_id")
q("outline", "blocks", "SELECT doc_id, block_idx, level, CAST(row_number() OVER (PARTITION BY doc_id, level ORDER BY block_idx) AS INT) AS number FROM blocks WHERE block_type = 'heading'")
q("section_lengths", "blocks", "SELECT doc_id, section, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS n FROM (SELECT doc_id, content, block_type, CAST(sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM blocks) AS t WHERE block_type <> 'heading' GROUP BY doc_id, section")
q("admonition_content", "blocks", "SELECT doc_id, block_idx, sentences FROM (SELECT doc_id, block_idx, CAST(length(content) - length(replace(content, '. ', ' ')) + 1 AS INT) AS sentences FROM blocks WHERE block_type IN ('admonition', 'blockquote')) AS t WHERE sentences > 3")
q("consumability_structure", "blocks", """SELECT doc_id, round(list_items / CAST(n AS DOUBLE), 6) AS list_ratio, round(paragraph_chars / CAST(greatest(paragraphs, 1) AS DOUBLE), 4) AS avg_paragraph,
  CAST(35 * (headings > 0) + 25 * (list_items > 0) + 20 * (paragraphs > 2) + 20 AS INT) AS structure FROM (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN block_type LIKE 'list_item%' THEN 1 ELSE 0 END) AS BIGINT) AS list_items,
  CAST(sum(CASE WHEN block_type = 'paragraph' THEN length(content) ELSE 0 END) AS BIGINT) AS paragraph_chars, CAST(sum(CASE WHEN block_type = 'paragraph' THEN 1 ELSE 0 END) AS BIGINT) AS paragraphs, CAST(sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) AS BIGINT) AS headings FROM blocks GROUP BY doc_id) AS t""".replace("(headings > 0)", "CASE WHEN headings > 0 THEN 1 ELSE 0 END").replace("(list_items > 0)", "CASE WHEN list_items > 0 THEN 1 ELSE 0 END").replace("(paragraphs > 2)", "CASE WHEN paragraphs > 2 THEN 1 ELSE 0 END"))
q("span_crosses_blocks", "blocks", "SELECT a.doc_id, a.block_idx, a.word FROM doubled AS a LEFT SEMI JOIN placed AS b ON a.doc_id = b.doc_id AND b.end_pos >= a.s AND b.end_pos < a.e",
  """placed AS (SELECT doc_id, block_idx, content, sum(length(content) + 1) OVER w - length(content) - 1 AS start_pos, sum(length(content) + 1) OVER w - 1 AS end_pos FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING)),
edges AS (SELECT *, lower(regexp_extract(content, '([A-Za-z]+)$', 1)) AS last_word, lower(regexp_extract(lead(content) OVER (PARTITION BY doc_id ORDER BY block_idx), '^([A-Za-z]+)', 1)) AS next_word FROM placed),
doubled AS (SELECT doc_id, block_idx, last_word AS word, end_pos - length(last_word) AS s, end_pos + 1 + length(next_word) AS e FROM edges WHERE last_word <> '' AND last_word = next_word)""")
q("nearest_occurrence", "issues", """SELECT doc_id, ord, CASE WHEN before IS NULL OR after - sent_idx < sent_idx - before THEN after ELSE before END AS nearest FROM (
  SELECT doc_id, ord, sent_idx, lag(sent_idx) OVER w AS before, lead(sent_idx) OVER w AS after FROM issues WINDOW w AS (PARTITION BY doc_id, rule_name, lower(flagged) ORDER BY ord)) AS t WHERE before IS NOT NULL OR after IS NOT NULL""")
q("repeated_page_text", "blocks", "SELECT content, count(DISTINCT doc_id) AS pages FROM blocks GROUP BY content HAVING count(DISTINCT doc_id) >= 3")
q("changed_blocks", "blocks", "SELECT n.doc_id, n.block_idx FROM hashed AS n LEFT ANTI JOIN hashed AS o ON o.doc_id = n.doc_id - 1 AND o.h = n.h", "hashed AS (SELECT doc_id, block_idx, sha2(concat(content, '|', block_type), 256) AS h FROM blocks)")
q("broken_references", "blocks", "SELECT b.doc_id, b.block_idx FROM blocks AS b LEFT ANTI JOIN (SELECT DISTINCT doc_id, level FROM blocks WHERE block_type = 'heading') AS a ON b.doc_id = a.doc_id AND b.level = a.level WHERE b.block_type <> 'heading'")

# -- modules: type by content, then each type's template
MODULES = """
shape AS (SELECT doc_id, count(*) AS n, count(CASE WHEN block_type = 'heading' THEN 1 END) AS headings, count(CASE WHEN block_type = 'list_item_ordered' THEN 1 END) AS steps, count(CASE WHEN block_type LIKE 'list_item%' THEN 1 END) AS items,
          count(CASE WHEN block_type IN ('table_cell', 'dlist') THEN 1 END) AS cells, count(CASE WHEN block_type = 'paragraph' THEN 1 END) AS paragraphs, min_by(content, CASE WHEN block_type = 'heading' THEN block_idx ELSE 1000000 + block_idx END) AS title,
          min(CASE WHEN block_type = 'heading' THEN block_idx END) AS first_heading, max(level) AS deepest FROM blocks GROUP BY doc_id),
modules AS (SELECT *, CASE WHEN steps > 0 THEN 'procedure' WHEN cells * 3 >= n THEN 'reference' WHEN headings > 5 THEN 'assembly' ELSE 'concept' END AS module_type FROM shape)"""
q("module_types", "blocks", "SELECT doc_id, module_type, headings, steps, items, cells, paragraphs FROM modules", MODULES)
MODULE_CHECKS = {
    "concept_module": ("concept", (("no_title", "headings = 0"), ("no_introduction", "paragraphs = 0"), ("many_lists", "items * 2 > n"), ("title_gerund", "regexp_like(title, '^[A-Z][a-z]+ing ')"), ("thin", "paragraphs < 2"))),
    "procedure_module": ("procedure", (("single_step", "steps = 1"), ("many_steps", "steps > 10"), ("title_not_gerund", "NOT regexp_like(title, '^[A-Z][a-z]+ing ')"), ("no_introduction", "paragraphs = 0"), ("subheadings", "headings > 4"))),
    "reference_module": ("reference", (("little_data", "cells < 4"), ("prose_heavy", "paragraphs > cells"), ("steps", "steps > 0"), ("no_title", "headings = 0"))),
    "assembly_module": ("assembly", (("nesting", "deepest > 3"), ("no_introduction", "paragraphs = 0"), ("few_modules", "headings < 3"), ("long_title", "length(title) > 80"))),
}
for _name, (_type, _checks) in MODULE_CHECKS.items():
    q(_name, "blocks", " UNION ALL ".join(f"SELECT doc_id, '{c}' AS check_name FROM modules WHERE module_type = '{_type}' AND {w}" for c, w in _checks), MODULES)
TEMPLATE = "(SELECT 'procedure' AS module_type, 'verif' AS wanted UNION ALL SELECT 'procedure', 'prereq' UNION ALL SELECT 'procedure', 'procedure' UNION ALL SELECT 'assembly', 'resources' UNION ALL SELECT 'assembly', 'next steps')"
q("template_compliance", "blocks", f"SELECT m.doc_id, m.module_type, t.wanted FROM modules AS m JOIN {TEMPLATE} AS t ON m.module_type = t.module_type LEFT ANTI JOIN (SELECT doc_id, lower(content) AS heading FROM blocks WHERE block_type = 'heading') AS h ON h.doc_id = m.doc_id AND contains(h.heading, t.wanted)", MODULES)
q("inter_module_analysis", "blocks", """SELECT from_type, to_type, CAST(sum(n) AS BIGINT) AS pairs FROM (
  SELECT 'assembly' AS from_type, module_type AS to_type, assemblies AS n FROM earlier UNION ALL SELECT 'concept', module_type, concepts FROM earlier
  UNION ALL SELECT 'procedure', module_type, procedures FROM earlier UNION ALL SELECT 'reference', module_type, refs FROM earlier) AS e WHERE n > 0 GROUP BY from_type, to_type""", MODULES + """,
earlier AS (SELECT module_type, count(CASE WHEN module_type = 'assembly' THEN 1 END) OVER w AS assemblies, count(CASE WHEN module_type = 'concept' THEN 1 END) OVER w AS concepts, count(CASE WHEN module_type = 'procedure' THEN 1 END) OVER w AS procedures, count(CASE WHEN module_type = 'reference' THEN 1 END) OVER w AS refs
  FROM modules WINDOW w AS (PARTITION BY lower(title) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
q("content_distribution", "blocks", "SELECT module_type, count(*) AS docs, round(avg(paragraphs), 6) AS paragraphs, round(avg(headings), 6) AS headings FROM modules GROUP BY ROLLUP (module_type)", MODULES)
q("heading_case", "blocks", "SELECT doc_id, block_idx FROM blocks WHERE block_type = 'heading' AND regexp_like(content, '^[A-Z][a-z]+( [A-Z][a-z]+){2,}')")
q("unit_consistency", "blocks", "SELECT b.doc_id, b.block_idx FROM (SELECT * FROM blocks WHERE block_type <> 'listing' AND regexp_like(content, '[0-9] ?(KB|MB|GB|TB)($|[^A-Za-z])')) AS b LEFT SEMI JOIN (SELECT doc_id FROM blocks WHERE block_type = 'listing' AND regexp_like(content, '[0-9] ?(KiB|MiB|GiB|TiB)')) AS c ON b.doc_id = c.doc_id")
q("term_markup", "blocks", "SELECT doc_id, term, min(block_idx) AS first_at FROM (SELECT doc_id, block_idx, explode(regexp_extract_all(regexp_replace(content, '`[^`]*`', ' '{g}), '([a-z]+_[a-z_]+)', 1)) AS term FROM blocks WHERE block_type <> 'listing') AS t GROUP BY doc_id, term")
q("admonitions", "blocks", "SELECT doc_id, block_idx FROM blocks WHERE regexp_like(content, '^[A-Z]{3,12}: ') AND NOT regexp_like(content, '^(NOTE|TIP|IMPORTANT|WARNING|CAUTION|ATTENTION|DANGER|FASTPATH|RESTRICTION|REMEMBER|NOTICE|TROUBLE): ')")
q("paragraph_indent", "blocks", "SELECT doc_id, block_idx FROM blocks WHERE block_type = 'paragraph' AND level > 0")
q("lite_markers", "blocks", "SELECT doc_id, block_idx, CASE WHEN block_type = 'heading' THEN concat(substr('######', 1, level), ' ', content) WHEN block_type = 'list_item_ordered' THEN concat(CAST(number AS VARCHAR(20)), '. ', content) WHEN block_type = 'list_item_unordered' THEN concat('- ', content) WHEN block_type = 'blockquote' THEN concat('> ', content) ELSE content END AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY block_idx) AS number FROM (SELECT *, sum(CASE WHEN block_type <> 'list_item_ordered' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) * 2 + CASE WHEN block_type = 'list_item_ordered' THEN 1 ELSE 0 END AS island FROM blocks) AS i) AS t")
q("outline_numbers", "blocks", "SELECT doc_id, block_idx, CAST(h1 AS INT) AS h1, CAST(row_number() OVER (PARTITION BY doc_id, h1 ORDER BY block_idx) - 1 AS INT) AS below FROM (SELECT doc_id, block_idx, level, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS h1 FROM blocks WHERE block_type = 'heading') AS t")
q("consumability", "blocks", """SELECT doc_id, structure, format_score, CAST(floor(0.4e0 * structure + 0.3e0 * content_score + 0.3e0 * format_score) AS INT) AS total, CASE WHEN 0.4e0 * structure + 0.3e0 * content_score + 0.3e0 * format_score >= 60 THEN 'good' ELSE 'needs work' END AS label FROM (
  SELECT doc_id, CASE WHEN headings > 0 THEN 35 ELSE 0 END + CASE WHEN headings > 2 THEN 25 ELSE 0 END + CASE WHEN items > 0 THEN 20 ELSE 0 END + CASE WHEN paragraphs > 2 THEN 20 ELSE 0 END AS structure,
    CASE WHEN paragraphs > 0 THEN 30 ELSE 0 END + CASE WHEN items < n THEN 25 ELSE 0 END + 25 AS content_score, CASE WHEN cells > 0 THEN 30 ELSE 0 END + CASE WHEN items > 0 THEN 30 ELSE 0 END + CASE WHEN headings > 0 THEN 20 ELSE 0 END AS format_score FROM modules) AS t""", MODULES)
q("short_topics", "text", "SELECT doc_id, count(*) AS sentences FROM sentences GROUP BY doc_id HAVING count(*) < 5")

# -- references between pages: an edge table, anchors, broken and mutual references
LINKS = """
edges AS (SELECT DISTINCT page_id AS source, lower(target) AS target FROM (SELECT page_id, explode(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) AS e WHERE target <> ''),
anchors AS (SELECT page_id, concat('/', lower(word)) AS anchor FROM (SELECT page_id, explode(regexp_extract_all(html, '<h1>([A-Za-z]+)', 1)) AS word FROM pages) AS a)"""
q("references", "pages", "SELECT source, target FROM edges", LINKS)
q("unresolved_references", "pages", "SELECT e.source, e.target FROM edges AS e LEFT ANTI JOIN anchors AS a ON e.target = a.anchor", LINKS)
q("resolved_references", "pages", "SELECT e.source, a.page_id AS target_page FROM edges AS e JOIN anchors AS a ON e.target = a.anchor", LINKS)
q("mutual_references", "pages", "SELECT p.source AS page_a, p.target AS page_b FROM (SELECT DISTINCT e.source, a.page_id AS target FROM edges AS e JOIN anchors AS a ON e.target = a.anchor) AS p JOIN (SELECT DISTINCT e.source, a.page_id AS target FROM edges AS e JOIN anchors AS a ON e.target = a.anchor) AS r ON p.source = r.target AND p.target = r.source WHERE p.source < p.target", LINKS)
q("reference_format", "pages", "SELECT source, target FROM edges WHERE regexp_like(target, '[.,;]$') OR regexp_like(target, '^https?://[^/]+$')", LINKS)

# -- lifecycle and feedback, over events as the log
q("latest_status", "events", "SELECT session_id, issue_id, max_by(status, event_id) AS status, count(*) AS changes FROM status_log GROUP BY session_id, issue_id", LIFECYCLE)
q("feedback_stats", "events", "SELECT rule_type, count(*) AS n, CAST(sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS BIGINT) AS thumbs_down, round(sum(CASE WHEN value < 10 THEN 1e0 ELSE 0e0 END) / count(*), 4) AS false_positive_rate FROM status_log GROUP BY rule_type", LIFECYCLE)
q("feedback_summary", "events", "SELECT rule_type, status, count(*) AS n FROM status_log GROUP BY CUBE (rule_type, status)", LIFECYCLE)
q("feedback_insights", "events", "SELECT CASE WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n, count(DISTINCT session_id) AS sessions FROM status_log GROUP BY 1", LIFECYCLE)
q("feedback_by_day", "events", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS day, count(*) AS n, count(DISTINCT session_id) AS sessions FROM status_log GROUP BY 1", LIFECYCLE)
q("feedback_by_hour", "events", "SELECT CAST(EXTRACT(HOUR FROM ts) AS BIGINT) AS hour_of_day, count(*) AS n FROM status_log GROUP BY 1", LIFECYCLE)
q("violations_with_feedback", "events", "SELECT v.rule_type, f.status, CAST(sum(v.n * f.n) AS BIGINT) AS n FROM (SELECT session_id, issue_id, rule_type, count(*) AS n FROM status_log WHERE status = 'open' GROUP BY session_id, issue_id, rule_type) AS v JOIN (SELECT session_id, issue_id, status, count(*) AS n FROM status_log WHERE status <> 'open' GROUP BY session_id, issue_id, status) AS f ON v.session_id = f.session_id AND v.issue_id = f.issue_id GROUP BY v.rule_type, f.status", LIFECYCLE)
q("superseded_runs", "events", "SELECT session_id, event_id, event_id < last_run AS cancelled FROM (SELECT session_id, event_id, max(event_id) OVER (PARTITION BY session_id) AS last_run FROM status_log) AS t", LIFECYCLE)
q("rate_limits", "events", "SELECT session_id, CAST(date_trunc('hour', ts) AS VARCHAR(30)) AS window_start, count(*) AS requests FROM status_log GROUP BY 1, 2 HAVING count(*) > 1", LIFECYCLE)
q("session_expiry", "events", "SELECT session_id, CAST(sum(CASE WHEN was IS NULL OR event_id - was > 200 THEN 1 ELSE 0 END) AS BIGINT) AS sessions FROM (SELECT session_id, event_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY event_id) AS was FROM status_log) AS t GROUP BY session_id", LIFECYCLE)
q("two_phase_results", "events", "SELECT session_id, min_by(status, event_id) AS partial_status, max_by(status, event_id) AS final_status FROM status_log GROUP BY session_id", LIFECYCLE)

# -- relational shapes that the catalogue of operators lists, over the star schema
q("price_summary", "star", "SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
q("customers_without_orders", "star", "SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS o ON c_custkey = o_custkey")
q("nation_revenue", "star", "SELECT n_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
q("top_orders", "star", "SELECT o_custkey, o_orderkey, CAST(r AS INT) AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) AS t WHERE r <= 3")


def _duck(sql: str) -> str:
    for a, b in RENAMED:
        sql = re.sub(rf"\b{a}\(", f"{b}(", sql)
    sql = re.sub(r"sha2\((.*?), 256\)", r"sha256(\1)", sql)
    return sql.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")


def _rounded(sql: str) -> str:
    """round(x, n) of doubles as DuckDB has it, which rounds x * 10^n; Spark's own goes by the decimal digits that x is shown with."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            raise ValueError("rounding within rounding")
        depth, comma, end = 1, None, m.end()
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        n = int(sql[comma + 1 : end - 1])
        out += f"{sql[at : m.start()]}(round(({sql[m.end() : comma]}) * 1e{n}, 0) / 1e{n})"
        at = end
    return out + sql[at:]


SYLLABLES = "token_syllables AS (SELECT doc_id, sent_idx, pos, token, greatest(1, size(regexp_extract_all(lower(token), '[aeiouy]+'{all})) - CASE WHEN regexp_like(lower(token), '[^aeiouyl](?:e|es|ed)$') THEN 1 ELSE 0 END) AS syllables FROM tokens)"


def _views(spark: SparkSession, sf_dir: str, base: str, guarded: bool = True) -> None:
    if base in ("text", "issues"):
        sents = T.sentences(R.prose(spark, sf_dir), keys=("doc_id", "lang"))
        sents.createOrReplaceTempView("sentences")
        T.tokens(sents).createOrReplaceTempView("tokens")
    if base == "issues":
        R.profile_issues(sents, guarded).createOrReplaceTempView("raw_issues")
    if base == "blocks":
        R.blocks(spark, sf_dir).createOrReplaceTempView("blocks")
    for t in {"events": ("events",), "star": ("lineitem", "orders", "customer", "nation"), "issues": ("labels",), "pages": ("pages",)}.get(base, ()):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _tables(base: str, tables: str, all_: str) -> str:
    own = {"text": [SENTENCE_WORDS, SYLLABLES], "issues": [SENTENCE_WORDS, SYLLABLES, ISSUES]}.get(base, [])
    return ",\n".join([x.replace("{all}", all_) for x in own] + ([tables.replace("{definitions}", DEFINITIONS)] if tables else []))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    base, tables, select = Q[name]
    _views(spark, sf_dir, base, name not in EVERY_LANGUAGE)
    head = _tables(base, tables, ", 0")
    return spark.sql(_rounded((f"WITH {head}\n" if head else "") + select.replace("{known}", KNOWN).replace("{g}", "")))


def sql(name: str) -> str:
    base, tables, select = Q[name]
    text = duck.TOKENS.replace("FROM documents", f"FROM {R.PROSE_SQL}")
    ctes = {"text": text, "issues": f"{text},\nraw_issues AS ({R.profile_issues_sql(name not in EVERY_LANGUAGE)})" if base == "issues" else "", "blocks": R.BLOCKS_SQL}.get(base, "")
    head = ",\n".join(x for x in (ctes, _duck(_tables(base, tables, ""))) if x)
    return (f"WITH {head}\n" if head else "") + _duck(select).replace("{known}", KNOWN).replace("{g}", ", 'g'")


def mutual_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "pages")
    links = lambda table: spark.sql(f"WITH {LINKS} SELECT * FROM {table}")
    return references.mutual(links("edges"), links("anchors"))


#: Queries that Spark plans otherwise than their SQL says it.
OWN = {"mutual_references": mutual_references}


def queries() -> dict:
    return {n: partial(run, n) for n in Q} | OWN


def oracle_sql() -> dict[str, str]:
    return {n: sql(n) for n in Q}
