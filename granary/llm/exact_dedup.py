"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass over 64-bit text hashes finds the digests that may be frequent; a
second pass over just those rows counts them by SHA-256 and picks each one's winner.
The winners, at most ``heavy`` of them, are broadcast and copies of a frequent text go on
the map side, so no hot key is shuffled. Every other digest is shuffled as usual, without
its text.

Defined results: texts are equal if their bytes are; null texts equal each other and no
empty text. The least doc_id of a group stays (a null doc_id only if no other is there);
of rows that repeat both doc_id and text one stays. An empty table gives an empty table.
Columns that come along, whatever their names, are those of the row that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.llm.common import fresh, sized
from granary.runtime import cut_lineage, frugal, ship

HEAVY = 1024  # most digests whose winners are broadcast
COUNTERS = 1024  # counters of each task's summary


def digest(text: Column | str) -> Column:
    """SHA-256 of a text as hex; the empty string for null."""
    return F.coalesce(F.sha2(F.col(text) if isinstance(text, str) else text, 256), F.lit(""))


class MisraGries:
    """Mergeable summary of at most ``k`` counters; a key seen more than n / (k + 1) times is among them."""

    def __init__(self, k: int) -> None:
        self.k, self.keys, self.counts = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        both, where = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.bincount(where, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        if len(both) > self.k:
            total -= np.partition(total, len(total) - self.k - 1)[len(total) - self.k - 1]
            keep = total > 0
            both, total = both[keep], total[keep]
        self.keys, self.counts = both, total


def frequent(hashes: DataFrame, column: str, heavy: int, counters: int) -> DataFrame:
    """(key) of at most ``heavy`` hashes that Misra-Gries finds frequent. Each task sends a bounded summary; summaries add up by key."""
    ship(hashes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = MisraGries(counters)
        for b in batches:
            s.add(b.column(0).to_numpy(zero_copy_only=False))
        yield pa.record_batch([pa.array(s.keys), pa.array(s.counts)], ["key", "low"])

    found = hashes.select(column).mapInArrow(frugal(run), "key bigint, low bigint")
    return found.groupBy("key").agg(F.sum("low").alias("low")).filter("low > 1").orderBy(F.desc("low"), "key").limit(heavy).select("key")


def heavy_winners(docs: DataFrame, id_col: str, text_col: str, heavy: int, counters: int) -> DataFrame:
    """(digest, winner) of the frequent texts, verified by exact counts."""
    hashed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    keys = cut_lineage(frequent(hashed, "key", heavy, counters))
    rows = hashed.join(F.broadcast(keys), "key", "left_semi")
    counted = rows.groupBy(digest("text").alias("digest")).agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("n"))
    return cut_lineage(counted.filter("n > 1").select("digest", "winner", F.lit(True).alias("hot")))


def kept_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest) of one document for each distinct text."""
    winners = heavy_winners(docs, id_col, text_col, heavy, counters)
    ids = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
    split = ids.join(F.broadcast(winners), "digest", "left")
    # Map side: of a frequent text only rows of the winner go on.
    left = split.filter(F.col("hot").isNull() | F.col("doc_id").eqNullSafe(F.col("winner")))
    return left.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Texts are only shuffled if the list of rows to drop is too large to broadcast."""
    dg, win, hot, act, other, oid = fresh(docs, "digest", "winner", "hot", "action", "digest2", "id2")
    winners = heavy_winners(docs, id_col, text_col, heavy, counters).toDF(dg, win, hot)
    rows = docs.withColumn(dg, digest(text_col)).join(F.broadcast(winners), dg, "left")
    rare = rows.filter(F.col(hot).isNull())
    place = F.row_number().over(W.partitionBy(dg).orderBy(F.col(oid).asc_nulls_last()))
    ranked = rare.select(F.col(dg), F.col(id_col).alias(oid)).withColumn(act, place)
    # drop: every row of this doc_id loses; else one of several equal rows wins.
    groups = ranked.groupBy(F.col(dg).alias(other), oid).agg(F.min(act).alias("__first"), F.count(F.lit(1)).alias("__n"))
    groups = groups.filter("__first > 1 or __n > 1").select(other, oid, (F.col("__first") > 1).alias(act))
    decisions, _ = sized(groups, 112)
    joined = rare.join(decisions, (F.col(dg) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(oid)), "left")
    parts = [joined.filter(F.col(act).isNull()), rows.filter(F.col(hot) & F.col(id_col).eqNullSafe(F.col(win))).dropDuplicates([dg])]
    if decisions.filter(~F.col(act)).limit(1).count():
        parts.append(joined.filter(~F.col(act)).dropDuplicates([dg]))
    out = parts[0].select(*docs.columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*docs.columns))
    return out


KEPT_SQL = """
SELECT min(doc_id) AS doc_id, coalesce(sha256(text), '') AS digest FROM documents GROUP BY coalesce(sha256(text), '')
"""
