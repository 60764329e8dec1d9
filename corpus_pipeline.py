"""The training-data pipeline: quality rules, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontam, packing, quality, secrets, simhash
from lodestar.llm.catalogue import tokenizer_file
from lodestar.llm.common import lean, read_table, written


#: Workers keep what earlier stages left in memory, so that packing's caches are smaller here than its own default.
CACHE_WORDS = 120_000
#: Near-duplicates share this much of their sets of so many words each.
SIMILARITY, SHINGLE = 0.8, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    lean(spark)
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    lean(spark)
    return simhash.drop_near_duplicates(docs, similarity=SIMILARITY, shingle=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    lean(spark)
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text."""
    lean(spark)
    return secrets.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    lean(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), cache_words=CACHE_WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sequence_packing", sequence_packing),
]

#: Several stages can't be said in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
