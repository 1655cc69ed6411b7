"""Session helpers: shipping the package to executors and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import ctypes
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per SparkContext, by way of the shared folder.

    Batches of texts are held to 8 MB, unless the session has a bound of its own: on both sides of the pipe a worker holds several at once."""
    sc = spark.sparkContext
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, "8m")
    if getattr(sc, "_granary_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, Path(_PACKAGE.name) / path.relative_to(_PACKAGE))
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/granary-{uuid.uuid4().hex}/granary-src.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target.toString())
    sc._granary_shipped = True


def frugal(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that leaves its Python worker small: workers are kept for later tasks, and what their allocators hold back counts against the executor."""

    @wraps(fn)
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        yield from fn(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a local one, deleted at exit, only where that is unset and all tasks run in this process."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = getattr(sc, "_granary_checkpoint", None)
        if shared is None:
            folder = tempfile.mkdtemp(prefix="granary-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            shared = sc._granary_checkpoint = "file://" + folder
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written out and counted: hinted for broadcast if its rows take no more than ``limit`` bytes, else left to shuffle joins."""
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() * row_bytes <= limit else stored


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever it lies."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
