"""Corpus pipeline: toxic documents go, then documents beyond the quality limits, then exact and near copies; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from granary.llm import exact_dedup, neardup, packing, quality, tokencount, toxicity
from granary.runtime import checkpoint_dir, forget, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, with stems learned from labels, rejects go. A null text is clean; each repeated row is judged by itself."""
    return toxicity.reject(docs, stems=toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the limits of their language and source go. A null or empty text stays; null languages and sources are groups."""
    return quality.accept(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least doc_id stays, null ids last; null texts equal each other. Of rows equal in both one stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the least doc_id stays. Rows without a doc_id or a word stay."""
    return neardup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Items of bins of 2,048 tokens. A text without a token gives none; repeated rows are items of their own."""
    return packing.packed(docs, count=tokencount.count)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The toxicity grammar and the Hamming join have no SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the whole of documents, by way of the shared folder, from which each stage's output goes once the next one's is written."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            forget(spark, before)
        before = f"{base}/{name}"
    return docs
