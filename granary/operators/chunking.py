"""Chunking: paragraphs, packed chunks, sentence chunks, token windows and chunk statistics.

Packing is a fold over one document at a time; it runs on whole-document rows in Arrow batches, so
nothing is shuffled. Everything else is expressions. Tokens are words unless another counter is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from granary.functions import text as t
from granary.runtime import frugal, ship

CHUNK = "doc_id string, chunk_id string, chunk_index int, text string, titles array<string>, sections array<string>, token_count int"


def count_words(text: str) -> int:
    return len(text.split())


class BytePairs:
    """Counts tokens of a byte-pair vocabulary, read from a rank file when first used in a process."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    loaded: dict[tuple[str, str], object] = {}

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.key = path, pattern

    def __call__(self, text: str) -> int:
        engine = BytePairs.loaded.get(self.key)
        if engine is None:
            import base64

            import tiktoken

            with open(self.key[0], "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            engine = BytePairs.loaded[self.key] = tiktoken.Encoding("own", pat_str=self.key[1], mergeable_ranks=ranks, special_tokens={})
        return len(engine.encode_ordinary(text))


def paragraphs(text: str) -> list[tuple[str, str | None, str | None]]:
    """(text, title, section). Headings set the title, a leading number the section, and both hold on until the next."""
    out, title, section = [], None, None
    for block in (b.strip() for b in re.split(r"\n\s*\n", text or "")):
        if not block:
            continue
        if m := re.fullmatch(r"#{1,6}\s+(.+)", block):
            title = m[1].strip()
            continue
        if m := re.fullmatch(r"(\d+(?:\.\d+)*)\s+(.+)", block):
            section, block = m[1], m[2]
        if len(block) < 100 and block.isupper():
            title = block
        else:
            out.append((block, title, section))
    return out


def pack(blocks: list[tuple[str, str | None, str | None]], limit: int = 1000, overlap: int = 100, count: Callable[[str], int] = count_words) -> list[dict]:
    """Paragraphs packed into chunks of up to ``limit`` tokens, the last paragraphs of at least ``overlap`` tokens repeated in the next.
    A paragraph over the limit is cut at sentences, its tail opening the next chunk without overlap. After an overlap a chunk may pass the limit."""
    done: list[dict] = []
    held: list[tuple[str, str | None, str | None]] = []
    size = 0

    def close(parts: list[tuple[str, str | None, str | None]]) -> None:
        text = "\n\n".join(p[0] for p in parts)
        done.append({"text": text, "titles": list(dict.fromkeys(p[1] for p in parts if p[1])), "sections": list(dict.fromkeys(p[2] for p in parts if p[2])), "token_count": count(text), "chunk_index": len(done)})

    for block in blocks:
        n = count(block[0])
        if n > limit:
            if held:
                close(held)
            run, used = [], 0
            for sentence in re.split(r"(?<=[.!?])\s+", block[0]):
                k = count(sentence)
                if run and used + k > limit:
                    close([(" ".join(run), *block[1:])])
                    run, used = [], 0
                run.append(sentence)
                used += k
            held, size = [(" ".join(run), *block[1:])], used
            continue
        if held and size + n > limit:
            close(held)
            tail, kept = [], 0
            while held and kept < max(overlap, 1):
                tail.insert(0, held.pop())
                kept += count(tail[0][0])
            held, size = tail, kept
        held.append(block)
        size += n
    if held:
        close(held)
    return done


def chunk_documents(docs: DataFrame, limit: int = 1000, overlap: int = 100, headers: bool = False, count: Callable[[str], int] = count_words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of every document, ids ``{doc_id}#chunk_{i}``; with ``headers`` each text opens with its first title."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for c in pack(paragraphs(text), limit, overlap, count):
                    body = f"[Section: {c['titles'][0]}]\n\n{c['text']}" if headers and c["titles"] else c["text"]
                    rows.append((doc, f"{doc}#chunk_{c['chunk_index']}", c["chunk_index"], body, c["titles"], c["sections"], c["token_count"]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "chunk_index", "text", "titles", "sections", "token_count"])

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, CHUNK)


def group_sentences(parts: list[str], limit: int = 500, overlap: int = 1, count: Callable[[str], int] = count_words) -> list[str]:
    """Sentences joined up to ``limit`` tokens, the last ``overlap`` of them repeated in the next group."""
    sizes, out, held = [count(p) for p in parts], [], []
    for i, n in enumerate(sizes):
        if held and sum(sizes[j] for j in held) + n > limit:
            out.append(" ".join(parts[j] for j in held))
            held = held[-overlap:] if overlap else []
        held.append(i)
    return [*out, " ".join(parts[j] for j in held)] if held else out


def sentence_chunks(docs: DataFrame, limit: int = 500, overlap: int = 1, count: Callable[[str], int] = count_words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, text, token_count). Sentences are split in the JVM; only the grouping runs in Python."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, c, count(c)) for d, parts in zip(batch["doc_id"], batch["parts"], strict=True) for i, c in enumerate(group_sentences(list(parts) if parts is not None else [], limit, overlap, count))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "token_count"])

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), t.sentences(text_col).alias("parts")).mapInPandas(run, "doc_id string, chunk_index int, text string, token_count int")


def token_windows(docs: DataFrame, limit: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, text, token_count) of sliding word windows. A document is split once, in Python, which splits bytes at the white space that Java's \\s is."""
    if overlap >= limit:
        raise ValueError("the overlap must be less than the window")
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("token_count", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, texts, sizes = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ws = text.as_py().split()
                for i, lo in enumerate(range(0, max(len(ws) - overlap, min(len(ws), 1)), limit - overlap)):
                    part = ws[lo : lo + limit]
                    at.append(row)
                    index.append(i)
                    texts.append(b" ".join(part))
                    sizes.append(len(part))
            yield pa.record_batch([batch.column("id").take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32())], schema.names)

    ready = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return ready.mapInArrow(frugal(run), schema)


def size_quality(chunks: DataFrame, small: int = 50, large: int = 1500) -> DataFrame:
    """One row of statistics over token_count; the deviation is the population's."""
    return chunks.agg(*_sizes(small, large))


def _sizes(small: int = 50, large: int = 1500) -> tuple[Column, ...]:
    x = F.col("token_count")
    return (F.count(F.lit(1)).alias("total_chunks"), F.avg(x).alias("avg_tokens"), F.min(x).alias("min_tokens"), F.max(x).alias("max_tokens"), F.stddev_pop(x).alias("std_tokens"), F.count_if(x < small).alias("too_small"), F.count_if(x > large).alias("too_large"))


def overlap_quality(chunks: DataFrame, span: int = 50) -> DataFrame:
    """One row: mean share of words that a chunk's end has in common with the next one's start. 1 below two chunks, 0 if no pair counts."""
    return _followed(measured(chunks, span)).agg(_shared())


SENTENCE = re.compile(rb"(?<=[.!?])\s+")


def cohering(text: bytes) -> float:
    """As :func:`granary.functions.text.coherence`, of a lower-cased text."""
    sets = [s for s in (set(p.split()) for p in SENTENCE.split(text)) if s]
    pairs = [len(a & b) / min(len(a), len(b)) for a, b in zip(sets, sets[1:], strict=False)]
    return sum(pairs) / len(pairs) if pairs else 1.0


def coherence(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and each text's coherence, null for a null text. Sentences are split once, in Python."""
    ship(docs.sparkSession)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("coherence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if (x := text.as_py()) is None else cohering(x) for text in batch.column("__low")]
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.float64())], schema.names)

    return docs.select(*keep, F.lower(text_col).cast("binary").alias("__low")).mapInArrow(frugal(run), schema)


def measured(chunks: DataFrame, span: int = 50, text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, token_count, coherence, head, tail): the distinct words of a chunk's first and last ``span``, in one pass over the texts."""
    ship(chunks.sparkSession)
    keep = ["doc_id", "chunk_index", *(["token_count"] if "token_count" in chunks.columns else [])]
    schema = T.StructType([*chunks.select(*keep).schema.fields, T.StructField("coherence", T.DoubleType()), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("head", "tail"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            calm, head, tail = [], [], []
            for text in batch.column("__low"):
                x = text.as_py()
                ws = (x or b"").split()
                calm.append(None if x is None else cohering(x))
                head.append(list(dict.fromkeys(ws[:span])))
                tail.append(list(dict.fromkeys(ws[-span:])))
            lists = (pa.array(x, pa.list_(pa.binary())).cast(pa.list_(pa.string())) for x in (head, tail))
            yield pa.record_batch([*batch.columns[:-1], pa.array(calm, pa.float64()), *lists], schema.names)

    return chunks.select(*keep, F.lower(text_col).cast("binary").alias("__low")).mapInArrow(frugal(run), schema)


def _followed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("after", F.lead("head").over(W.partitionBy("doc_id").orderBy("chunk_index")))


def _shared() -> Column:
    a, b = F.size("tail"), F.size("after")
    share = F.when((a > 0) & (b > 0), F.size(F.array_intersect("tail", "after")) / F.least(a, b))
    return F.when(F.count(F.lit(1)) < 2, F.lit(1.0)).otherwise(F.coalesce(F.avg(share), F.lit(0.0))).alias("overlap_quality")


def recommendations(small: int = 50, large: int = 1500, target: int = 800) -> Column:
    """Advice on columns of size_quality, overlap_quality and avg_coherence."""
    n, share = F.col("total_chunks"), lambda c: F.col(c) > F.col("total_chunks") * 0.1
    good = F.array(F.lit("chunk sizes and boundaries look good"))
    found = F.array_compact(F.array(
        F.when(share("too_small"), F.format_string(f"%d of %d chunks are below {small} tokens: lower the minimum", "too_small", n)),
        F.when(share("too_large"), F.format_string(f"%d of %d chunks exceed {large} tokens: lower the maximum", "too_large", n)),
        F.when(F.col("std_tokens") > target * 0.5, "sizes vary widely: make boundaries more even"),
        F.when(F.col("avg_coherence") < 0.5, "low coherence: chunks may span subjects"),
        F.when(F.col("overlap_quality") < 0.3, "little overlap: raise overlap_tokens"),
    ))
    return F.when(F.size(found) == 0, good).otherwise(found)


def quality_report(chunks: DataFrame) -> DataFrame:
    """All statistics of a chunk table with the advice they lead to; coherence over all chunks. The texts are read once."""
    rows = _followed(measured(chunks)).agg(*_sizes(), _shared(), F.avg("coherence").alias("avg_coherence"))
    return rows.withColumn("recommendations", recommendations())
