"""Corpus pipeline: quality classifier, quality rules, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
:func:`run` writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.llm import jaccard, packing, quality, rules, substrings
from sedgetable.llm.words import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents among the k highest Gumbel keys of the importance ratio; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return quality.classified(docs, labels).filter("kept").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table; the others go."""
    return rules.judged(docs).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    SimHash fingerprints of five-word shingles meet by ring search, and those that they leave apart by
    minima; near copies share at least 0.8 of the shingles (Jaccard), which is checked exactly. Ids of the
    others are joined out. Rows with a repeated id share their fate, and documents without id stay, as
    nothing can name them.
    """
    marked = jaccard.near_copies(docs.select("doc_id", "text"))
    others = marked.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier in the corpus are cut out; ``n_chars`` follows the text."""
    cut = substrings.without_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("bigint"))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("retrieval_packing", retrieval_packing),
]

# Importance resampling, XXH64 fingerprints and BPE ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
