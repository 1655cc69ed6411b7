"""Structured Streaming over event tables: windows, sessions, deduplication and circuit state."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.governance import BREAKERS, Breaker
from granary.runtime import checkpoint_dir, forget, ship


def read(spark: SparkSession, sf_dir: str, name: str = "events", time_col: str = "ts", files: int = 64) -> DataFrame:
    """A table as a stream of ``files`` files a trigger, its time as a timestamp that can carry a watermark."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    rows = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn(time_col, F.col(time_col).cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its result table: all appended rows, or the last complete one.
    State, progress and results lie in the shared checkpoint folder; the state goes when all is read."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/{'all' if mode == 'complete' else f'part={number}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    forget(spark, f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows/all" if mode == "complete" else f"{base}/rows/part=*")


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) by window of event time."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """(start, n, mean) by overlapping windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """(by, start, n): runs of events no further apart than the gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str | None = "1 hour") -> DataFrame:
    """Rows whose keys haven't come within the watermark; state is bounded by it, and rows later than that are dropped. Without ``late``, as for the replay of a
    whole table whose files are in no order of time, nothing is dropped and every key is kept."""
    if late is None:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def counters(events: DataFrame, by: str = "event_type") -> DataFrame:
    """Running metric counters."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


PIECE = 10_000
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # a call without a time, which comes last


def _micros(ts: pd.Series) -> np.ndarray:
    """Microseconds since 1970, as wall-clock time in the session's zone counts them."""
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def replay(key: tuple, batches: Iterator[pd.DataFrame], state, known: dict[str, tuple[int, float, int]]) -> Iterator[pd.DataFrame]:
    """One service's calls of a trigger. They are held as nine bytes each and put in order; what they lead to leaves in pieces."""
    b = Breaker(*known.get(key[0], BREAKERS["llm"]))
    if state.exists:
        b.state, b.count, b.last, b.good = state.get
    held = [(_micros(rows["ts"]), rows["ok"].to_numpy(bool)) for rows in batches]
    at, ok = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    order = np.lexsort((ok, np.where(at == NONE, LAST, at)))
    for lo in range(0, len(order), PIECE):
        part = order[lo : lo + PIECE]
        ts, good = at[part], ok[part]
        out = [(b.call(t / 1e6 if t != NONE else math.nan, g), b.state) for t, g in zip(ts.tolist(), good.tolist(), strict=True)]
        if lo + PIECE >= len(order):
            state.update((b.state, b.count, b.last, b.good))
        yield pd.DataFrame({"service": key[0], "ts": ts.view("datetime64[us]").astype("datetime64[ns]"), "ok": good, "allowed": [a for a, _ in out], "state": [s for _, s in out]})


def breakers(events: DataFrame, limits: dict[str, tuple[int, float, int]] | None = None) -> DataFrame:
    """(service, ts, ok, allowed, state) of a stream of calls (service, ts, ok), each service's breaker kept as state between batches."""
    known = limits or BREAKERS
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        yield from replay(key, batches, state, known)

    schema = "service string, ts timestamp, ok boolean, allowed boolean, state string"
    return events.select("service", "ts", "ok").groupBy("service").applyInPandasWithState(step, schema, "state string, n int, last double, good int", "append", "NoTimeout")


def micro_batches(stream: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, every: str = "50 milliseconds", files: int = 1):
    """Runs ``process`` on each micro-batch and appends what it gives to a table; the query is returned."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/micro-{uuid.uuid4().hex}").trigger(processingTime=every).start()
