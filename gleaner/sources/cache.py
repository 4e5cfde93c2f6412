"""The feature cache: Parquet partitioned by analyzer version, looked up by joins; only valid rows are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hits(work: DataFrame, cache: DataFrame, analyzer: str) -> DataFrame:
    """Cached rows of the work's fingerprints, under the work's current paths."""
    rows = cache.where(F.col("analyzer") == analyzer).drop("path")
    return work.select("path", "fingerprint").join(rows, "fingerprint")


def misses(work: DataFrame, cache: DataFrame, analyzer: str) -> DataFrame:
    """Fingerprints still to analyse, each once, with its first path."""
    left = work.join(cache.where(F.col("analyzer") == analyzer).select("fingerprint"), "fingerprint", "left_anti")
    return left.groupBy("fingerprint").agg(F.min("path").alias("path"))


def upserted(cache: DataFrame, new: DataFrame, version: str = "written") -> DataFrame:
    """The cache with ``new`` rows in place of those with their key; among several the latest ``version`` stays."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = W.partitionBy("fingerprint", "analyzer").orderBy(F.desc("_new"), F.desc(version))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_new")


def append(new: DataFrame, path: str) -> None:
    """Write new rows; readers take the latest of a key by ``upserted``."""
    new.write.mode("append").partitionBy("analyzer").parquet(path)
