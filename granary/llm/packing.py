"""Harmonic packing of documents into sequences of a fixed capacity.

An item of length n belongs to class capacity // n: n is at most 1/class of the
capacity, so a bin of that class holds exactly ``class`` items and is more than class / (class + 1) full. Bins of a class
are filled by count alone, no search for room. There is a class for each quotient, some 2 * sqrt(capacity) of them, so the shortest items
fill their bins as well. A longer document is cut into whole capacities
and a remainder. Slices of about ``slice_docs`` documents, by hash of the id, are packed independently: work per
slice is bounded, slices grow in number with the corpus whatever its ids look like, and a slice leaves at most one
unfilled bin a class. Only ids and lengths are shuffled.

Lengths are numbers of words, runs of other than ASCII white space, unless others are given: :func:`packed` takes a ``count``, such as
``tokencount.count``, whose n_tokens are the lengths then.

Defined results: null texts
and texts without a word give no item. Ids may be of any type; a row without one is placed by the hash of its length. Within a slice and class items go in order of
id (nulls first), piece and length. Repeated rows are packed each by itself. An
empty table gives no item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CAPACITY, SLICE_DOCS = 2048, 1 << 16


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n) in words."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint").alias("n"))


def pack(items: DataFrame, capacity: int = CAPACITY, slice_docs: int = SLICE_DOCS, rows: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, class, bin, slot) from rows of (doc_id, n); piece, class and slot count from 0, 1 and 0. ``rows``: how many there are, if known."""
    if capacity < 1 or slice_docs < 1:
        raise ValueError("capacity and slice_docs are at least 1")
    slices = -(-(items.count() if rows is None else rows) // slice_docs) or 1
    # Items without length are dropped after the pieces are made (and explode_outer infers no filter), so that lengths aren't counted twice, once to filter by them.
    cut = items.select("doc_id", "n", F.explode_outer(F.expr(f"sequence(0L, greatest(n - 1, 0L) div {capacity}L)")).alias("piece"))
    sized = cut.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("length"), "n").filter("length > 0")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.col("n").cast("string"))))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % slices
    classed = sized.withColumn("class", F.expr(f"{capacity}L div length")).withColumn("slice", place).drop("n")
    nth = F.row_number().over(W.partitionBy("slice", "class").orderBy("doc_id", "piece", "length")) - 1
    placed = classed.withColumn("nth", nth.cast("bigint"))
    name = F.concat_ws("-", "slice", "class", F.expr("nth div class"))
    return placed.select("doc_id", "piece", "start", "length", "class", name.alias("bin"), F.expr("nth % class").alias("slot"))


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    slice_docs: int = SLICE_DOCS,
    count: Callable[[DataFrame, str, str], DataFrame] | None = None,
) -> DataFrame:
    """The items of documents; ``count`` gives (doc_id, n_tokens) where lengths aren't words."""
    items = lengths(docs, id_col, text_col) if count is None else count(docs, id_col, text_col).select("doc_id", F.col("n_tokens").alias("n"))
    return pack(items, capacity, slice_docs, docs.count())


PACK_SQL = r"""
WITH l AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))::BIGINT AS n FROM documents),
cut AS (SELECT doc_id, n, unnest(range((n - 1) // 2048 + 1)) AS piece FROM l WHERE n > 0),
s AS (SELECT doc_id, n, piece, piece * 2048 AS start, least(n - piece * 2048, 2048) AS length FROM cut),
c AS (SELECT *, 2048 // length AS class, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'n' || n)), 1, 8))::BIGINT % greatest((SELECT (count(*) + 65535) // 65536 FROM documents), 1) AS slice FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY slice, class ORDER BY doc_id NULLS FIRST, piece, length) - 1 AS nth FROM c)
SELECT doc_id, piece, start, length, class, slice || '-' || class || '-' || (nth // class) AS bin, nth % class AS slot FROM p
"""
