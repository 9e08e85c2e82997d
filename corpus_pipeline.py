"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; `run` writes each stage's result as
Parquet in the shared folder and reads it back. Null and empty texts pass through every stage by the rule of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locuskit.llm import exact_dedup, ngram_join, packing, pii, quality
from locuskit.llm.shared import stash, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share four fifths of their five-word shingles, directly or by way of others."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # Workers serve other stages too: a smaller cache of words that goes with its task, for the same result.
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=150_000, lasting=False))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", first_copies),
    ("near_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Trees, tokens and learnt patterns can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
