"""Vectors in blocks: one row holds many of them, so that comparing blocks is a matrix product."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.runtime import ship

BLOCK = 2048
ROWS = 256  # queries of a block that are multiplied at once


def matrix(lists: pa.Array) -> np.ndarray:
    """float64 rows of unit length of a list column without nulls; a row of zeros stays one."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = values.reshape(len(lists), -1)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def blocks(vectors: DataFrame, id_col: str, vector_col: str, ids: str, name: str) -> DataFrame:
    """(ids array, name binary): unit vectors in blocks of up to ``BLOCK``, made where the rows lie. Rows without an id or a vector are left out."""
    ship(vectors.sparkSession)
    schema = T.StructType([T.StructField(ids, T.ArrayType(vectors.schema[id_col].dataType)), T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                m = matrix(part.column(1))
                one = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.record_batch([one, pa.array([m.tobytes()], pa.binary())], [ids, name])

    whole = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    return whole.select(id_col, vector_col).mapInArrow(run, schema)


def products(crossed: DataFrame, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], types: dict[str, T.DataType]) -> DataFrame:
    """(query_id, id, cos) of the pairs that ``keep`` (query numbers, cosines) marks, from rows (query_id array, q, id array, v)."""
    schema = T.StructType([T.StructField(c, t) for c, t in types.items()] + [T.StructField("cos", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qid, did = batch.column("query_id")[i].values, batch.column("id")[i].values
                q = np.frombuffer(batch.column("q")[i].as_py()).reshape(len(qid), -1)
                v = np.frombuffer(batch.column("v")[i].as_py()).reshape(len(did), -1)
                for lo in range(0, len(qid), ROWS):
                    cos = q[lo : lo + ROWS] @ v.T
                    a, b = np.nonzero(keep(np.arange(lo, lo + len(cos)), cos))
                    yield pa.record_batch([qid.take(pa.array(lo + a)), did.take(pa.array(b)), pa.array(cos[a, b])], schema.names)

    return crossed.select("query_id", "q", "id", "v").mapInArrow(run, schema)


def centres(vectors: DataFrame, vector_col: str, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of at most ``cells`` cells by spherical k-means, fitted on the driver from at most ``sample`` vectors, those with the least hashes."""
    rows = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(vector_col).orderBy(F.xxhash64(vector_col)).limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 1))
    m = matrix(rows.column(0).combine_chunks())
    rng = np.random.default_rng(seed)
    c = m[rng.permutation(len(m))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(m[lo : lo + BLOCK] @ c.T, 1) for lo in range(0, len(m), BLOCK)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-30), c)
    return c


def in_cells(vectors: DataFrame, id_col: str, vector_col: str, c: np.ndarray, probes: int = 1) -> DataFrame:
    """(id, v, cell): each unit vector once for each of its ``probes`` nearest cells. Rows without an id or a vector are left out."""
    ship(vectors.sparkSession)
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("v", T.BinaryType()), T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                m = matrix(part.column(1))
                k = min(probes, len(c))
                near = np.argpartition(-(m @ c.T), k - 1, axis=1)[:, :k]
                rows = pa.array(np.repeat(np.arange(len(m)), k))
                flat = pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.record_batch([part.column(0).take(rows), flat.take(rows), pa.array(near.reshape(-1).astype(np.int32))], schema.names)

    whole = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    return whole.select(id_col, vector_col).mapInArrow(run, schema)


def sign_bands(vectors: DataFrame, id_col: str, vector_col: str, bands: int, bits: int, seed: int) -> DataFrame:
    """(id, v, key) for each band: the signs of ``bits`` random projections, with the band's number above them."""
    ship(vectors.sparkSession)
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column(1))
            planes = np.random.default_rng(seed).normal(size=(m.shape[1], bands * bits))
            signs = ((m @ planes) > 0).reshape(len(m), bands, bits)
            keys = signs @ (1 << np.arange(bits, dtype=np.int64)) | (np.arange(bands, dtype=np.int64) << 32)

            def lists(x: np.ndarray) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))

            yield pa.record_batch([batch.column(0), lists(m), lists(keys)], schema.names)

    whole = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    return whole.select(id_col, vector_col).mapInArrow(run, schema)
