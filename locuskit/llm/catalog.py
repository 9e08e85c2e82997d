"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locuskit.llm import byte_pairs, chat, edit_counts, exact_dedup, filter_audit, hard_negatives, ngram_join, packing, pieces, pii, quality, url_filter, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_embedding_near_dedup": vector_dedup.op3_embedding_near_dedup,
    "op4_packing": packing.op4_packing,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_token_counts": edit_counts.op6_token_counts,
    "op7_quality": quality.op7_quality,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_pii": pii.op9_pii,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_byte_bpe": byte_pairs.op11_byte_bpe,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
