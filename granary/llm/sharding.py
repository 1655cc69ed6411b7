"""Sharding by longest processing time: groups that must stay together go, largest first, to the least loaded shard.

Group sizes are one aggregation. Sorted by size they stream through a heap of shard loads in one
task, whose memory is the heap; there are as many rows there as groups, not documents. The
assignment is then joined to the documents, by broadcast only if its measured size allows.

Defined results: a group is a distinct combination of the group columns, nulls included.
A document's size is its length in characters, 0 for null or empty. Groups of equal size go by
their columns in ascending order, nulls last; of equally loaded shards the least number is taken.
Every row gives one row, repeated rows and null doc_ids too; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import fresh, sized
from granary.runtime import frugal, ship

SHARDS = 16


def lpt(sizes: Iterable[int], heap: list[tuple[int, int]]) -> Iterator[int]:
    """The shard of each size, sizes in descending order; ``heap`` holds (load, shard)."""
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        yield shard


def assign(docs: DataFrame, groups: list[str], shards: int = SHARDS, text_col: str = "text") -> DataFrame:
    """The group columns, then the size and the shard of each group under names that clash with none of them."""
    if shards < 1 or not groups:
        raise ValueError("at least one shard and one group column")
    ship(docs.sparkSession)
    (size,) = fresh(docs.select(*groups), "size")
    sums = docs.groupBy(*groups).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")).alias(size))
    ordered = sums.repartition(1).sortWithinPartitions(F.desc(size), *[F.col(g).asc_nulls_last() for g in groups])

    (name,) = fresh(sums, "shard")
    schema = sums.schema.add(name, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, s) for s in range(shards)]
        for b in batches:
            out = list(lpt(b.column(b.num_columns - 1).to_pylist(), heap))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=schema.names)

    return ordered.mapInArrow(frugal(run), schema)


def shard(docs: DataFrame, groups: list[str], shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups..., shard) for every row."""
    keys = fresh(docs, *[f"g{i}" for i in range(len(groups))])
    (target,) = fresh(docs, "shard")
    found = assign(docs, groups, shards, text_col)
    plan, _ = sized(found.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(found.columns[-1]).alias(target)), 128)
    on = F.lit(True)
    for g, k in zip(groups, keys, strict=True):
        on = on & F.col(g).eqNullSafe(F.col(k))
    return docs.select(id_col, *groups).join(plan, on).select(F.col(id_col).alias("doc_id"), *groups, F.col(target).alias("shard"))


SHARD_SQL = """
WITH RECURSIVE g AS (SELECT lang, source, sum(coalesce(length(text), 0))::BIGINT AS size,
    row_number() OVER (ORDER BY sum(coalesce(length(text), 0)) DESC, lang ASC NULLS LAST, source ASC NULLS LAST) AS i FROM documents GROUP BY lang, source),
lpt(i, loads, shard) AS (SELECT 0::BIGINT, list_transform(range(16), lambda k: 0::BIGINT), -1::BIGINT
    UNION ALL SELECT g.i, list_transform(range(16), lambda k: l.loads[k + 1] + CASE WHEN k + 1 = list_position(l.loads, list_min(l.loads)) THEN g.size ELSE 0 END),
    (list_position(l.loads, list_min(l.loads)) - 1)::BIGINT FROM lpt l JOIN g ON g.i = l.i + 1)
SELECT d.doc_id, d.lang, d.source, l.shard::INTEGER AS shard FROM documents d
JOIN g ON d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source JOIN lpt l ON l.i = g.i
"""
