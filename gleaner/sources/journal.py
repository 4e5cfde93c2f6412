"""The run journal: an append-only table of states; the latest of a run is its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = "run_id string, written timestamp, status string, stage string, done long, total long, source string, config string, analyzer string, resumed int, error string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """All states from JSON lines; lines that can't be read have no run_id and are dropped."""
    return spark.read.schema(STATES).option("mode", "PERMISSIVE").json(path).where("run_id is not null")


def record(state: DataFrame, path: str) -> None:
    state.write.mode("append").json(path)


def latest(states: DataFrame, key: str = "run_id", at: str = "written") -> DataFrame:
    """One row for each run: its last state."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in rest])


def resumable(states: DataFrame, source: str, config: str, analyzer: str) -> DataFrame:
    """The newest run that isn't complete and has the same source, policy and analyzer; no row if there is none."""
    same = (F.col("source") == source) & (F.col("config") == config) & (F.col("analyzer") == analyzer)
    return latest(states).where(same & (F.col("status") != "complete")).orderBy(F.desc("written"), F.desc("run_id")).limit(1)


def worth_recording(done, total):
    """States are recorded for the first, the last and each hundredth item."""
    return (done <= 1) | (done == total) | (done % 100 == 0)
