"""Centroids and drift of embedding batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.functions import numeric as n


def centroids(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """(by, centroid): mean vector of each group, of unit length unless it is 0."""
    parts = vectors.select(by, F.posexplode(vector_col).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    size = n.norm("c")
    return lists.select(by, F.when(size > 0, F.transform("c", lambda x: x / size)).otherwise(F.col("c")).alias("centroid"))


def drift_scores(batches: DataFrame, reference: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """(by, drift_score): mean cosine of each batch's vectors to its reference centroid."""
    near = batches.join(reference, by)
    return near.groupBy(by).agg(F.avg(n.cosine(vector_col, "centroid")).alias("drift_score"))


def alerts(scores: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Rows below the threshold with their severity."""
    return scores.withColumn("severity", n.drift_severity("drift_score", threshold)).filter("severity is not null").withColumn("threshold", F.lit(threshold))


def recent_alerts(found: DataFrame, severity: str | None = None, since: str | None = None, at: str = "timestamp") -> DataFrame:
    """Alerts of a severity after a time; either may be left out."""
    out = found if severity is None else found.filter(F.col("severity") == severity)
    return out if since is None else out.filter(F.col(at) > F.lit(since).cast("timestamp"))


def moved(old: str, new: str, alpha: float = 0.1):
    """Reference moved towards a new centroid, of unit length again."""
    mean = F.zip_with(old, new, lambda a, b: (1 - alpha) * a + alpha * b)
    size = n.norm(mean)
    return F.when(size > 0, F.transform(mean, lambda x: x / size)).otherwise(mean)


def drift_stats(scores: DataFrame, order: str, threshold: float = 0.90, last: int = 100) -> DataFrame:
    """Each batch with the counters up to it and the mean and least score of the last ``last`` batches."""
    upto, recent = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0), W.orderBy(order).rowsBetween(1 - last, 0)
    return scores.select(
        "*", F.count(F.lit(1)).over(upto).alias("checks"), F.sum((F.col("drift_score") < threshold).cast("int")).over(upto).alias("alerts"),
        F.max(1 - F.col("drift_score")).over(upto).alias("max_drift"), F.avg("drift_score").over(recent).alias("recent_mean"), F.min("drift_score").over(recent).alias("recent_min"),
    )
