"""Outside checkers and models as optional providers: a callable on batches, empty results by default.

A provider gets a list of texts and gives a list of lists of matches (offset in UTF-16 units, length, message, rule_id,
replacements). Texts are batched up to a size; a failing batch gives no matches and does not fail the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MATCHES = "doc_id long, start int, `end` int, message string, rule_id string, replacements array<string>"
BATCH_CHARS = 6000
#: Rules whose matches never count, and the most replacements kept.
SUPPRESSED = ("WHITESPACE_RULE", "UPPERCASE_SENTENCE_START", "MORFOLOGIK_RULE_CODE")
MOST_REPLACEMENTS = 5

Provider = Callable[[list[str]], list[list[dict]]]


def nothing(texts: list[str]) -> list[list[dict]]:
    return [[] for _ in texts]


def to_code_points(text: str, offset: int) -> int:
    """A code-point offset for one in UTF-16 units."""
    return len(text.encode("utf-16-le")[: 2 * offset].decode("utf-16-le", "ignore"))


def batches(texts: list[str], most: int = BATCH_CHARS) -> Iterator[list[int]]:
    """Indices of texts, packed greedily up to a number of characters."""
    now, used = [], 0
    for k, t in enumerate(texts):
        if now and used + len(t) > most:
            yield now
            now, used = [], 0
        now.append(k)
        used += len(t)
    if now:
        yield now


def check(docs: DataFrame, provider: Provider = nothing) -> DataFrame:
    """Matches of a provider, in code points, without suppressed rules and code in backticks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, rows = [t or "" for t in pdf.text], []
            for group in batches(texts):
                try:
                    found = provider([texts[k] for k in group])
                except (OSError, ValueError):
                    found = [[] for _ in group]
                for k, matches in zip(group, found, strict=True):
                    for m in matches:
                        start, end = to_code_points(texts[k], m["offset"]), to_code_points(texts[k], m["offset"] + m["length"])
                        if m.get("rule_id") not in SUPPRESSED and texts[k][:start].count("`") % 2 == 0:
                            rows.append((pdf.doc_id.iloc[k], start, end, m.get("message", ""), m.get("rule_id", ""), list(m.get("replacements", []))[:MOST_REPLACEMENTS]))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "message", "rule_id", "replacements"])

    return docs.select("doc_id", "text").mapInPandas(run, MATCHES)
