"""Written tables: they cut lineage and live in the shared folder, so any executor may be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a temporary folder of a session on one machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gleaner.scratch", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("gleaner.scratch", root)
    return root.rstrip("/")


class Tables:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
