"""Context under a token budget, and prompts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as t
from granary.runtime import ship

CONTEXT = "query_id string, context string, token_count int, chunks_included int, chunks_truncated int, sources array<struct<doc_id:string,chunk_id:string,score:double,title:string>>"
SEPARATOR = "\n\n---\n\n"
LEAST_USEFUL = 200


def fill(chunks: list[dict], budget: int, separator: str = SEPARATOR, scores: bool = True, count: Callable[[str], int] = lambda s: len(s.split())) -> dict:
    """Chunks in order while they fit. One that doesn't is cut if more than 200 tokens are left, and later ones are still tried; else filling ends."""
    parts, sources, used, cut = [], [], 0, 0
    gap = count(separator)
    for i, c in enumerate(chunks, 1):
        head = f"[Source {i}] doc={c['doc_id']} chunk={c['id']}" + (f" | score: {c['score']:.2f}" if scores else "") + (f"\nTitle: {c['title']}" if c.get("title") else "")
        body, lead = f"{head}\n\n{c['text']}", gap if parts else 0
        if used + lead + count(body) > budget:
            room = budget - used - lead
            if room <= LEAST_USEFUL:
                break
            body = f"{head}\n\n{' '.join(c['text'].split()[: max(room - count(head) - 20, 0)])}..."
            cut += 1
        used += lead + count(body)
        parts.append(body)
        sources.append({"doc_id": c["doc_id"], "chunk_id": c["id"], "score": c["score"], "title": c.get("title")})
    return {"context": separator.join(parts), "token_count": used, "chunks_included": len(parts), "chunks_truncated": cut, "sources": sources}


def assemble(results: DataFrame, budget: int = 3000, separator: str = SEPARATOR, scores: bool = True) -> DataFrame:
    """One context per query from rows (query_id, rank, id, doc_id, title, text, score). The rule depends on order, so each query is
    one fold; results are gathered by query first, and only then handed to Python in Arrow batches."""
    ship(results.sparkSession)
    rows = results.select(F.col("query_id").cast("string"), F.struct("rank", F.col("id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "title", "text", F.col("score").cast("double").alias("score")).alias("r"))
    gathered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([{"query_id": q, **fill([dict(x) if isinstance(x, dict) else x.asDict() for x in rs], budget, separator, scores)} for q, rs in zip(batch["query_id"], batch["rs"], strict=True)])

    return gathered.mapInPandas(run, CONTEXT)


def simple_context(chunks: DataFrame) -> DataFrame:
    """(query_id, context) of rows (query_id, rank, doc_id, chunk_id, text), one after the other."""
    rows = chunks.select("query_id", F.struct("rank", t.simple_chunk("rank", "doc_id", "chunk_id", "text").alias("s")).alias("r"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["s"]), "\n\n").alias("context"))


#: Prompts; {context} and {query} are filled in.
PROMPTS = {
    "grounded_qa": "Answer the question from the context alone. Where it has no answer, say: Not found in context. Be brief and cite as [Source n].\n\nContext:\n{context}\n\nQuestion: {query}\n\nAnswer:",
    "structured": 'Answer from the context alone, as JSON {"answer": text, "sources": [{"doc_id": id, "chunk_id": id}], "confidence": low, medium or high}; without an answer there, "Not found in context".\n\nContext:\n{context}\n\nQuestion: {query}\n\nJSON:',
    "summarization": "Summarise the context for the task: main points as a list, key figures, caveats.\n\nContext:\n{context}\n\nTask: {query}\n\nSummary:",
    "compliance": "As a compliance analyst use the context only, nothing from elsewhere. Cite every statement as [Source n]; where the context is silent say: Information not available in provided documents.\n\nContext:\n{context}\n\nQuestion: {query}\n\nAnalysis:",
}


def prompt(context: str | Column, query: str | Column, kind: str | Column) -> Column:
    """The filled prompt of a kind; an unknown kind is grounded_qa."""
    template = F.lit(PROMPTS["grounded_qa"])
    for name, p in PROMPTS.items():
        template = F.when(t.col(kind) == name, F.lit(p)).otherwise(template)
    return F.replace(F.replace(template, F.lit("{query}"), t.col(query)), F.lit("{context}"), t.col(context))


def truncate(text: str | Column, limit: int, strategy: str = "end") -> Column:
    """A text of at most ``limit`` words as it is; else its first words (end), its first 0.4 and last words (middle), or its first words up to the
    last sentence end in the second half (smart)."""
    ws = t.words(text)
    head = F.array_join(F.slice(ws, 1, limit), " ")
    if strategy == "middle":
        a = int(limit * 0.4)
        cut = F.concat(F.array_join(F.slice(ws, 1, a), " "), F.lit("\n\n[...content truncated...]\n\n"), F.array_join(F.slice(ws, F.size(ws) - (limit - a) + 1, F.lit(limit - a)), " "))
    elif strategy == "smart":
        cut = head
        for mark in ("! ", "? ", ". "):
            at = F.length(head) - F.locate(mark[::-1], F.reverse(head))
            cut = F.when(F.contains(head, F.lit(mark)) & (at - 1 > F.length(head) * 0.5), F.substring(head, F.lit(1), at)).otherwise(cut)
    else:
        cut = head
    return F.when(F.size(ws) <= limit, t.col(text)).otherwise(cut)
