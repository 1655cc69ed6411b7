"""Command line: ingest files into a Parquet table and print the counters as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.sources.files import EXTENSIONS, ingest


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="granary-ingest")
    p.add_argument("path")
    p.add_argument("--out")
    p.add_argument("--tenant", default="default")
    p.add_argument("--flat", action="store_true", help="don't descend into directories")
    p.add_argument("--extensions", nargs="*", default=list(EXTENSIONS))
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = ingest(spark, a.path, a.tenant, recursive=not a.flat, extensions=tuple(a.extensions))
    if a.out:
        docs.withColumn("tenant_id", F.lit(a.tenant)).write.partitionBy("tenant_id").mode("append").parquet(a.out)
    stats = docs.agg(F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.sum(F.length("text")).alias("total_chars")).first().asDict()
    print(json.dumps(stats))
    return stats


if __name__ == "__main__":
    main()
