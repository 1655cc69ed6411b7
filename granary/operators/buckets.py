"""Rows that meet under a key, however many there are: hot keys are cut into blocks, and each two blocks meet in a cell of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.runtime import sized


def cells(keyed: DataFrame, block: int) -> DataFrame:
    """(key, x, y, side, id) of rows (key bigint, id) whose key has more than one. A key with no more than ``block`` rows is one cell, (0, 0), of side 0.

    Others are counted first, so that their lists are never gathered, and cut into blocks by the hash of the id. Block x meets block y in the cell (x, y), with sides 1 and 2;
    in the cell (x, x) its own rows, of side 0, meet each other."""
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    hot = sized(counts.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), 16)
    split = keyed.join(hot, "key", "left")
    few = split.filter("blocks is null").groupBy("key").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)
    flat = few.select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), F.explode("ids").alias("id"))
    own = F.expr("pmod(xxhash64(id), blocks)").cast("int")
    many = split.filter("blocks is not null").select("key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.expr("case when own = other then 0 when own < other then 1 else 2 end")
    return flat.unionAll(many.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "id"))


def gathered(entries: DataFrame) -> DataFrame:
    """Rows of :func:`cells` with the columns joined to them, cell by cell and in order of side."""
    return entries.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of :func:`gathered` put together so that no cell is cut. A cell that goes on in the next batch is held back; it has no more than two blocks."""
    kept: list[pa.RecordBatch] = []

    def cell(batch: pa.RecordBatch, i: int) -> list[int]:
        return [batch.column(c)[i].as_py() for c in range(3)]

    for batch in batches:
        if not batch.num_rows:
            continue
        last, same = cell(batch, batch.num_rows - 1), np.ones(batch.num_rows, bool)
        for c, v in enumerate(last):
            same &= batch.column(c).to_numpy() == v
        at = int(np.argmax(same))
        if at == 0 and kept and cell(kept[0], 0) == last:
            kept.append(batch)
            continue
        done = pa.Table.from_batches([*kept, batch.slice(0, at)])
        kept = [batch.slice(at)]
        if done.num_rows:
            yield done
    if kept:
        yield pa.Table.from_batches(kept)


def numbered(table: pa.Table) -> np.ndarray:
    """The number of each row's cell."""
    key, x, y = (table.column(c).to_numpy() for c in range(3))
    return np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
