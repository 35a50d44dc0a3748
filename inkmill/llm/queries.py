"""The llm operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compaction, conversation_trie, kneser_ney, line_dedup, media, packing, pii, quality_rules, resampling, sentence_pieces, signature_trees, simhash, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        token_store.op1_token_store,
        sentence_pieces.op2_sentence_pieces,
        pii.op3_pii,
        packing.op4_packing,
        simhash.op5_simhash,
        line_dedup.op6_line_dedup,
        media.op7_media,
        compaction.op8_sharding,
        kneser_ney.op9_quality_classifier,
        quality_rules.op10_quality_rules,
        signature_trees.op11_signature_trees,
        conversation_trie.op12_conversation_trie,
        resampling.op13_resampling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {**quality_rules.SQL, **signature_trees.SQL, **conversation_trie.SQL, **resampling.SQL}
