"""Streams: new items are analysed once and appended to the cache; events are counted in event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import cache


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Rows of Parquet files as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def analyse_into_cache(work: DataFrame, path: str, analyzer: str, analyse: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run over what has arrived: fingerprints that the cache lacks are analysed and appended; a replayed batch adds nothing.

    ``analyse`` makes cache rows (fingerprint, analyzer and features) of (fingerprint, path).
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        try:
            known = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001  the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = spark.createDataFrame([], "fingerprint string, analyzer string")
        cache.append(analyse(cache.misses(rows, known, analyzer)), path)

    return work.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, event_type, events, value) by tumbling windows; ``ts`` is cast, as watermarks need a time zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, events) of runs of events without a longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), user).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def completed(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """The stream's result after all that has arrived, as a table under ``path``; nothing is gathered on the driver.

    In complete mode each batch holds the whole result, so the last one counts; in append mode all do.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
