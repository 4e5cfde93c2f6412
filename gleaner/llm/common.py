"""Shared pieces: durable intermediate tables, skew-safe lookups, prefix sums, Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import shared_root

#: ASCII white space of every operator here: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"

#: A key with more than one in HEAVY of all rows is heavy; there are fewer than HEAVY such keys, whatever the data.
HEAVY = 1024

#: Tasks a core of a stage that writes.
WAVES = 4


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a few megabytes at a time, however many rows that is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: Each empties a cache that a Python worker keeps from task to task.
CACHES: list[Callable[[], None]] = []


def trim() -> None:
    """Give the system back what this worker's earlier tasks have freed; Spark uses a worker for one operator after the other."""
    pa.default_memory_pool().release_unused()
    if back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        back(0)


def let_go() -> None:
    """Empty all caches of this worker, for an operator that uses none of them."""
    for empty in CACHES:
        empty()
    trim()


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, small: bool = False, by_partition: bool = False, **options) -> DataFrame:
        """Write ``df`` once and read it back; what follows starts from the written files.

        ``small``: a table of a fraction of the documents' size, written by a quarter of the tasks.
        ``by_partition``: rows hold their partition's number, so partitions are written as they are.
        """
        at = f"{self.path}/{name}"
        df = df if by_partition else gathered(df, 1 if small else WAVES)
        df.write.options(**options).parquet(at)
        return self.spark.read.schema(nullable(df.schema)).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def gathered(df: DataFrame, waves: int = WAVES) -> DataFrame:
    """The same rows in fewer tasks, so that many small partitions don't make many small files.

    There are ``waves`` tasks a core at least, and a task takes no more than 8 * WAVES / ``waves`` shuffle partitions.
    """
    spark = df.sparkSession
    return df.coalesce(max(8, waves * spark.sparkContext.defaultParallelism, waves * parallelism(spark) // (8 * WAVES)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def squeezed(text):
    """The text with each run of ASCII white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def dealt(df: DataFrame, n: int, keys: list[str], order: list) -> DataFrame:
    """Rows with equal ``keys`` in one of ``n`` partitions, each sorted by ``order``, for a function over partitions.

    Dealt by a number of its own: a repartition by the very keys of a join below would be merged with that join's
    shuffle, which adaptive execution may then read in another way, so that equal keys end up apart.
    """
    return df.withColumn("_deal", F.xxhash64(*keys)).repartition(n, "_deal").sortWithinPartitions(*order).drop("_deal")


def skew_safe_lookup(rows: DataFrame, index: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of many rows with an index that is unique by ``keys``; ``weight`` counts each key's rows.

    Keys that hold more than 1/HEAVY of all rows, of which there are fewer than HEAVY by arithmetic,
    are joined by broadcast and never shuffled; every other key is small enough for one task.
    Both inputs should be written tables, as each is read twice.
    """
    total = index.agg(F.sum(weight)).first()[0] or 0
    heavy = index.where(F.col(weight) * HEAVY > F.lit(total))
    cold = index.where(F.col(weight) * HEAVY <= F.lit(total))
    hot = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return hot.unionByName(rest.join(cold, keys))


def ranked_sums(df: DataFrame, groups: list[str], key: str, value: str, out: str, chunk_bits: int = 12) -> DataFrame:
    """Exclusive running sum of ``value`` within ``groups`` in the order of ``key``, a well-mixed 64-bit number.

    The order is cut into 2**chunk_bits equal ranges of the key, so that no window holds more than a few
    thousandths of a group: sums of ranges are added up first, then rows within each range.
    """
    from pyspark.sql import Window as W

    chunked = df.withColumn("_chunk", F.shiftrightunsigned(F.col(key), 64 - chunk_bits))
    ordered = chunked.withColumn("_signed", F.col(key).bitwiseXOR(F.lit(-(1 << 63))))
    by_chunk = W.partitionBy(*groups).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = (
        chunked.groupBy(*groups, "_chunk").agg(F.sum(value).alias("_s"))
        .withColumn("_before", F.coalesce(F.sum("_s").over(by_chunk), F.lit(0))).drop("_s")
    )
    renamed = before.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_chunk").alias("_c"), "_before")
    same = F.col("_chunk") == F.col("_c")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = W.partitionBy(*groups, "_chunk").orderBy("_signed").rowsBetween(W.unboundedPreceding, -1)
    return (
        ordered.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(renamed, same).withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_chunk", "_signed", "_within", "_c", "_before", *[f"_g{i}" for i in range(len(groups))])
    )


def connected_components(ws: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge (a, b).

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014) on written tables until nothing
    moves; hubs are looked up by skew_safe_lookup.  No list of neighbours is ever collected.
    """
    edges = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-0", small=True)
    was = None
    for step in range(1, 2 * max_rounds + 1):
        both = edges.union(edges.select("b", "a")) if step % 2 else edges
        lows = ws.save(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
                       .withColumn("m", F.least("a", "m")), f"cc-low-{step}", small=True)
        near = skew_safe_lookup(both, lows, ["a"], "_n")
        if step % 2:
            new = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lows.select("a", F.col("m").alias("b")))
        edges = ws.save(new.where("a <> b").distinct(), f"cc-{step}", small=True)
        ws.drop(f"cc-{step - 1}", f"cc-low-{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if step % 2 == 0:  # unchanged by a large-star and a small-star step
            if now == was:
                break
            was = now
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    parents = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return parents.union(roots)


def in_batches(table: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold about ``most`` bytes of ``column`` (one row at least)."""
    for batch in table:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        if not len(size):
            continue
        block = np.cumsum(size.astype(np.int64)) // most
        cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(size)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as one array, and each row's offsets in it; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def binary_list(column: pa.Array) -> list[bytes]:
    """Each row's bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
