"""Search and answering end to end, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import numeric as n
from granary.functions import text as t
from granary.operators import context, retrieval, verify


def search(index: DataFrame, queries: DataFrame, top_k: int = 5, filters: dict[str, object] | None = None, expand: bool = False) -> DataFrame:
    """Hybrid search of ``index`` (doc_id, text, embedding, ...) for ``queries`` (query_id, text, qvec); filters apply before scoring."""
    return retrieval.hybrid(retrieval.where(index, filters), retrieval.expanded(queries) if expand else queries, top_k)


def answer(
    index: DataFrame, queries: DataFrame, generate: Callable[[Column], Column], top_k: int = 5, budget: int = 3000, filters: dict[str, object] | None = None,
    kind: str = "grounded_qa", rerank: bool = True, critic: Column | None = None, title_col: str | None = None,
) -> DataFrame:
    """(query_id, answer, confidence, status, issues, sources, prompt). ``generate`` maps the prompt to an answer, by a pandas UDF where it calls a model.

    Twice ``top_k`` results of the hybrid search are reranked by their vectors, cut and rid of likenesses, put into a context within the budget,
    answered, and held against the context. A query without results gets the fallback answer and low confidence."""
    found = search(index, queries, 2 * top_k, filters).select("query_id", F.col("doc_id").alias("id"), "combined_score")
    meta = index.select(F.col("doc_id").alias("id"), "text", "embedding", (F.col(title_col) if title_col else F.lit(None).cast("string")).alias("title"))
    rows = found.join(meta, "id").join(queries.select("query_id", "qvec"), "query_id")
    if rerank:
        best = retrieval.lightweight(rows, top_k)
    else:
        best = retrieval.ranked(rows.withColumn("final_score", F.col("combined_score")), top_k, "final_score", "id")
    kept = retrieval.drop_similar(best).select("query_id", "id")
    chosen = best.join(kept, ["query_id", "id"], "left_semi").select("query_id", "rank", "id", F.col("id").alias("doc_id"), "title", "text", F.col("final_score").alias("score"))
    whole = context.assemble(chosen, budget).select(F.col("query_id").alias("qid"), "context", "sources")
    asked = queries.select("query_id", F.col("text").alias("query")).join(whole, F.col("query_id").cast("string") == F.col("qid"), "left")
    ready = asked.withColumn("prompt", context.prompt("context", "query", F.lit(kind)))
    said = ready.withColumn("answer", F.when(F.col("context").isNull(), verify.FALLBACK).otherwise(generate(F.col("prompt")))).withColumn("context", F.coalesce("context", F.lit("")))
    checked = verify.verify(said, critic=critic)
    sure = F.when(F.col("sources").isNull(), "low").otherwise(n.confidence("status"))
    return checked.select("query_id", "answer", sure.alias("confidence"), "status", "issues", "sources", "prompt")


def first_source(prompt: Column) -> Column:
    """A stand-in for a model: the first sentence of the first source in a prompt."""
    body = F.regexp_extract(prompt, r"\[Source 1\][^\n]*\n(?:Title:[^\n]*\n)?\n([\s\S]*?)(?:\n\n---\n\n|\n\nQuestion:|$)", 1)
    return F.element_at(t.plain_sentences(body), 1)


def metrics(runs: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """One row: requests and their nearest-index latency percentiles. No requests give zeros."""
    from granary.operators.evaluate import latency_nearest

    found = latency_nearest(runs.select(F.lit(0).alias("all"), F.col(latency).cast("double").alias("ms")), "all", "ms").drop("all")
    counted = runs.agg(F.count(F.lit(1)).alias("requests"))
    return counted.join(found, F.lit(True), "left").select("requests", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "min", "max", "p50", "p95", "p99")])
