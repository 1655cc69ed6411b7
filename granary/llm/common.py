"""What the operators share: fresh column names, Arrow mapping and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.runtime import cut_lineage, frugal, ship

BROADCAST_BYTES = 64 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df`` (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        pick, i = f"__{name}", 0
        while pick.lower() in taken:
            i += 1
            pick = f"__{name}_{i}"
        taken.add(pick.lower())
        out.append(pick)
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Each Arrow batch of ``df`` through ``fn``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(frugal(run), schema)


def extended(df: DataFrame, columns: dict[str, T.DataType]) -> T.StructType:
    """The schema of ``df`` with columns added."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """``df`` written out and counted: hinted for broadcast if its rows take no more than ``limit`` bytes, else left to shuffle joins."""
    stored = cut_lineage(df)
    n = stored.count()
    return (F.broadcast(stored) if n * row_bytes <= limit else stored), n
