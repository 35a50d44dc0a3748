"""DuckDB texts shared by the queries' SQL."""

WORD = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def parts(c: str) -> str:
    return f"string_split_regex(regexp_replace(coalesce({c}, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '\\n+')"


#: (doc_id, lang, sent_idx, sentence) of documents
SENTENCES = f"""s0 AS (SELECT doc_id, lang, {parts('text')} AS p FROM documents),
s1 AS (SELECT doc_id, lang, unnest(p) AS piece, (generate_subscripts(p, 1) - 1)::INTEGER AS sent_idx FROM s0),
sentences AS (SELECT doc_id, lang, sent_idx, {strip('piece')} AS sentence FROM s1 WHERE {strip('piece')} <> '')"""

#: (doc_id, sent_idx, words) and (doc_id, sent_idx, pos, token)
TOKENS = f"""{SENTENCES},
w0 AS (SELECT doc_id, lang, sent_idx, sentence, regexp_extract_all(sentence, '{WORD}') AS words FROM sentences),
tokens AS (SELECT doc_id, sent_idx, unnest(words) AS token, (generate_subscripts(words, 1) - 1)::INTEGER AS pos FROM w0)"""


def finds(source: str, keys: str, text: str, pattern: str) -> str:
    """SELECT keys, text, hit, start, "end" for every find of pattern in source.text."""
    p = lit(pattern)
    return f"""SELECT {keys}, {text}, unnest(hits) AS hit, unnest(starts) AS start_, unnest(list_transform(range(1, len(hits) + 1), lambda k: (starts[k] + hl[k])::INTEGER)) AS end_ FROM (
      SELECT *, list_transform(range(1, len(hits) + 1), lambda k: (list_sum(gl[1:k]) + coalesce(list_sum(hl[1:k - 1]), 0))::INTEGER) AS starts FROM (
        SELECT {keys}, {text}, hits, list_transform(string_split_regex({text}, {p}), lambda g: length(g)) AS gl, list_transform(hits, lambda h: length(h)) AS hl FROM (
          SELECT {keys}, {text}, regexp_extract_all({text}, {p}) AS hits FROM {source} WHERE regexp_matches({text}, {p}))))"""


def blocks() -> str:
    """CTEs up to html_blocks(doc_id, block_idx, block_type, level, content) of pages."""
    from ..sources import html

    t = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
    for tag in html.SKIPPED:
        t = f"regexp_replace({t}, '(?is)<{tag}[ >].*?</{tag}>', '', 'g')"
    text = "regexp_replace(body, '<[^>]*>', ' ', 'g')"
    for entity, sign in html.ENTITIES:
        text = f"replace({text}, {lit(entity)}, {lit(sign)})"
    return f"""b0 AS (SELECT page_id AS doc_id, string_split(regexp_replace({t}, {lit(html.TAGS)}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM pages),
b1 AS (SELECT doc_id, unnest(p) AS piece, (generate_subscripts(p, 1) - 1)::INTEGER AS block_idx FROM b0),
b2 AS (SELECT doc_id, block_idx, CASE WHEN contains(piece, chr(2)) THEN lower(string_split(piece, chr(2))[1]) ELSE '' END AS tag,
       CASE WHEN contains(piece, chr(2)) THEN string_split(piece, chr(2))[2] ELSE piece END AS body FROM b1),
b3 AS (SELECT doc_id, block_idx, tag, regexp_replace(regexp_replace({text}, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g') AS content,
       last_value(CASE WHEN tag IN ('ol', 'ul') THEN tag END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx) AS opened FROM b2),
html_blocks AS (SELECT doc_id, block_idx, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'li' AND opened = 'ol' THEN 'list_item_ordered'
       WHEN tag = 'li' THEN 'list_item_unordered' WHEN tag IN ('dt', 'dd') THEN 'dlist' WHEN tag = 'pre' THEN 'listing' WHEN tag = 'blockquote' THEN 'blockquote'
       WHEN tag IN ('td', 'th') THEN 'table_cell' ELSE 'paragraph' END AS block_type,
       CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN substr(tag, 2, 1)::INTEGER ELSE 0 END AS level, content FROM b3 WHERE content <> '')"""
