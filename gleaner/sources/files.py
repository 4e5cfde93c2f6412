"""Item files: discovery, fingerprints, decoding and labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import parse_label

#: Suffixes of supported images, in any case.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./?#]+)$", 1)).isin(*SUFFIXES)


def discover(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, size_bytes, content if asked) of supported files anywhere below ``root``.

    Contents stay unread unless they are asked for; a missing folder is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(supported(F.col("path")))
    return files.select("path", F.col("length").alias("size_bytes"), *(["content"] if content else []))


def fingerprint(files: DataFrame) -> DataFrame:
    """(path, size_bytes, fingerprint): SHA-256 of each file's bytes."""
    return files.select("path", "size_bytes", F.sha2("content", 256).alias("fingerprint"))


def indexed(df: DataFrame, order: str = "path") -> DataFrame:
    """``item_index`` from 1 in the order of a column."""
    return numbered(df, [], order, "item_index")


def numbered(df: DataFrame, groups: list[str], order: str, name: str) -> DataFrame:
    """``name``: each row's number from 1 in its group (of columns without nulls), in the order of a column.

    Ranges of groups and order are counted, then numbered on, so that a group of any size is dealt to many tasks; there are
    as many counts as ranges and groups.
    """
    from .store import Tables

    keys = [*groups, order]
    parts = Tables(df.sparkSession, "numbered").save(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "parts")
    counts = parts.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy(*groups, "_part").orderBy(order))
    joined = parts.withColumn("_own", own).join(F.broadcast(before) if not groups else before, [*groups, "_part"])
    return joined.withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def labelled_samples(spark: SparkSession, path: str, score: str, label: str, required: bool = False) -> DataFrame:
    """(score, label) of a CSV with a header; a byte-order mark is passed over.

    Without ``required`` a missing column gives no samples and rows that lack a value are passed over; with it either
    is an error, a missing column at once and a missing value when the rows are read.
    """
    raw = spark.read.option("header", "true").csv(path)
    rows = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    lacking = [c for c in (score, label) if c not in rows.columns]
    if lacking and required:
        raise ValueError(f"{path} has no column {' and no column '.join(lacking)}")
    if lacking:
        return spark.createDataFrame([], "score double, label boolean")
    filled = (F.trim(F.coalesce(score, F.lit(""))) != "") & (F.trim(F.coalesce(label, F.lit(""))) != "")
    if required:
        return rows.select(F.when(filled, F.trim(score).cast("double")).otherwise(F.raise_error(F.lit("a sample lacks its score or label")).cast("double")).alias("score"), parse_label(F.col(label)).alias("label"))
    return rows.where(filled).select(F.trim(score).cast("double").alias("score"), parse_label(F.col(label)).alias("label"))


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, channels, data, valid): what the JVM decodes; broken files are rows that aren't valid."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), (F.col("image.height") > 0).alias("valid"))


def analysed(files: DataFrame, analyse: Callable[[pd.DataFrame], pd.DataFrame], schema: str, failed: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Vectorised analysis of file rows; a batch whose analysis fails is done row by row, and rows that fail become ``failed`` ones."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield analyse(batch)
            except Exception:  # noqa: BLE001  a model may raise anything
                for i in range(len(batch)):
                    row = batch.iloc[i : i + 1]
                    try:
                        yield analyse(row)
                    except Exception:  # noqa: BLE001
                        yield failed(row)

    return files.mapInPandas(scan, schema)
