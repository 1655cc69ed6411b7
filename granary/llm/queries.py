"""Queries of the training-data operators, each over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import chat, exact_dedup, lm, neardup, packing, quality, sharding, tokencount, toxicity, unigram
from granary.runtime import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, stems=toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_ids(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accept(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), ["lang", "source"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"))


def sentencepiece_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op9: the texts back from their pieces."""
    return unigram.decode(op9_sentencepiece(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_chat_formatting, op2_toxicity, op3_exact_dedup, op4_minhash_near_dedup, op5_quality_rules,
        op6_sharding, op7_token_counts, op8_lm_scoring, op9_sentencepiece, op10_packing, pipeline, sentencepiece_decoding,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.KEPT_SQL,
        "op5_quality_rules": quality.KEPT_SQL,
        "op6_sharding": sharding.SHARD_SQL,
        "op10_packing": packing.PACK_SQL,
        "sentencepiece_decoding": unigram.DECODED_SQL,
    }
