"""Retrieval quality and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.functions import numeric as n


def metrics(runs: DataFrame, k: int | None = None, scorer: Column | None = None) -> DataFrame:
    """Rows (query_id, retrieved, expected, latency_ms) with recall, precision, mrr, ndcg and score (``scorer`` or .6 recall + .4 precision)."""
    out = runs.withColumn("recall", n.recall("retrieved", "expected", k)).withColumn("precision", n.precision("retrieved", "expected", k)).withColumn("mrr", n.reciprocal_hit("retrieved", "expected")).withColumn("ndcg", n.ndcg("retrieved", "expected", k))
    return out.withColumn("score", n.eval_score("recall", "precision") if scorer is None else scorer)


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Means of the metrics and linear percentiles of the latency."""
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(f"mean_{c}") for c in ("score", "recall", "precision", "mrr", "ndcg")], p.alias("p")).select(*by, "n_queries", *[f"mean_{c}" for c in ("score", "recall", "precision", "mrr", "ndcg")], *[F.col("p")[i].alias(f"p{q}_latency") for i, q in enumerate((50, 95, 99))])


def compare(runs: DataFrame, first: str, second: str) -> DataFrame:
    """One row of differences of two runs (run_id, metrics...); an error if either is missing."""
    names = [c for c in runs.columns if c != "run_id"]
    rows = runs.filter(F.col("run_id").isin(first, second))
    both = rows.agg(*[F.max(F.when(F.col("run_id") == r, F.col(c))).alias(f"{s}_{c}") for r, s in ((first, "a"), (second, "b")) for c in names], F.count_distinct("run_id").alias("found"))
    return both.filter(F.assert_true(F.col("found") == F.lit(1 if first == second else 2), "a run is missing").isNull()).select(*[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in names])


def save_run(results: DataFrame, path: str, run_id: str, version: str, at: str) -> None:
    """Appends a run to the two stored tables below ``path``: results (rows of :func:`metrics`) by run, and runs with its summary."""
    rows = results.drop("run_id").withColumn("run_id", F.lit(run_id))
    rows.write.mode("append").partitionBy("run_id").parquet(f"{path}/results")
    stored = results.sparkSession.read.parquet(f"{path}/results").filter(F.col("run_id") == run_id)
    one = summary(stored, "run_id").select(F.col("run_id").cast("string"), F.lit(at).cast("timestamp").alias("timestamp"), F.lit(version).alias("pipeline_version"), F.struct(*[c for c in summary(stored).columns]).alias("summary"))
    one.write.mode("append").parquet(f"{path}/runs")


def compare_stored(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Differences of two stored runs' summaries."""
    runs = spark.read.parquet(f"{path}/runs").select("run_id", "summary.*")
    return compare(runs, first, second)


def latency_linear(rows: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Percentiles with linear interpolation."""
    return rows.groupBy(by).agg(F.percentile(value, F.array(*map(F.lit, points))).alias("p")).select(by, *[F.col("p")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(points)])


def latency_nearest(rows: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Mean, extremes and the element at floor(n * p) of the sorted values. Values are counted first, on the map side, so what is sorted are
    a group's distinct values, not its rows."""
    held = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(by)
    placed = held.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(q)), F.col(value))).alias(f"p{round(100 * q)}") for q in points]
    return placed.groupBy(by).agg((F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *at)


def rolling(rows: DataFrame, by: str, order: tuple[str, ...], value: str, size: int = 1000) -> DataFrame:
    """Each row with mean, least and greatest of the last ``size`` values of its group."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(1 - size, 0)
    return rows.select("*", F.avg(value).over(w).alias("rolling_mean"), F.min(value).over(w).alias("rolling_min"), F.max(value).over(w).alias("rolling_max"))
