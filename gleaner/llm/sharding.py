"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered from 0 in ascending order of doc_id; a keyed Feistel network over the smallest even-bit domain
that holds them, applied again until it lands below the row count, permutes the numbers.  Row p of the
permuted order goes to shard p mod shards, slot p div shards: shard sizes are at most one apart, slots are
gapless, and shard and slot of any row, or the row of any shard and slot, are computed without data.

Cases: ties of doc_id are ordered by the text's hash, size and checksum (equal rows in any order); null doc_ids come first; null
text has size 1 and checksum 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WAVES, Workspace, nullable, parallelism

SHARDS, SEED, ROUNDS = 16, 42, 8


class Feistel:
    """A permutation of 0 to n - 1."""

    def __init__(self, n: int, seed: int = SEED):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        if self.half > 31:
            raise ValueError("more than 2**62 rows")
        self.keys = np.random.default_rng(seed).integers(0, 1 << 62, ROUNDS, np.uint64)
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.half)

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        with np.errstate(over="ignore"):
            for key in self.keys[::-1] if inverse else self.keys:
                left, right = (right ^ self._round(left, key), left) if inverse else (right, left ^ self._round(right, key))
        return left << np.uint64(self.half) | right

    def __call__(self, rows: np.ndarray, inverse: bool = False) -> np.ndarray:
        x = self._once(np.asarray(rows, np.uint64), inverse)
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = self._once(x[out], inverse)
        return x.astype(np.int64)


def locate(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number."""
    p = int(Feistel(n, seed)(np.array([row]))[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number in a slot of a shard."""
    return int(Feistel(n, seed)(np.array([slot * shards + shard]), inverse=True)[0])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n))], [*batch.schema.names, "part", "local"])
        done += n


def _place(n: int, shards: int, seed: int, names: tuple[str, str, str] = ("row", "shard", "slot")):
    """Adds the shard and slot of each row number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Feistel(n, seed)
        for batch in batches:
            p = permute(batch.column(names[0]).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], [*batch.schema.names, *names[1:]])

    return scan


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, tie, row, shard, slot) for every row; texts are read once and never shuffled."""
    ws = Workspace(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    bare = ws.save(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("tie")), "bare")
    order = ["doc_id", "tie", "size", "text_crc32"]
    sorted_ = bare.repartitionByRange(min(parallelism(ws.spark), WAVES * ws.spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    local = ws.save(sorted_.mapInArrow(_local, "doc_id long, size long, text_crc32 long, tie long, part int, local long"), "local", by_partition=True)
    counts = sorted((r.part, r.n) for r in local.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each partition
    total = sum(n for _, n in counts)
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    base = ws.spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "part int, base long")
    rows = local.join(F.broadcast(base), "part").select(*order, (F.col("base") + F.col("local")).alias("row"))
    return rows.mapInArrow(_place(total, shards, seed), "doc_id long, tie long, size long, text_crc32 long, row long, shard int, slot long")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The rows of ``docs``, with all their columns, in shuffled order: Parquet folders _shard=k of files sorted by _slot.

    Whole rows are sorted and numbered as ``shard_rows`` numbers them, so nothing is joined and repeated or null doc_ids are
    rows like any other.
    """
    ws = Workspace(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_tie": F.xxhash64("text"), "_size": F.octet_length(text) + 1, "_crc": F.crc32(text.cast("binary"))})
    order = ["doc_id", "_tie", "_size", "_crc"]
    n = parallelism(ws.spark)
    sorted_ = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop(*order[1:])
    local = ws.save(sorted_.withColumn("_id", F.monotonically_increasing_id()), "rows", by_partition=True)  # the partition's number and the row's in it
    split = local.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_local": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = sorted((r["_part"], r["n"]) for r in split.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each partition
    starts = np.cumsum([0, *(c for _, c in counts)]).tolist()
    base = ws.spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "_part int, _base long")
    numbers = split.join(F.broadcast(base), "_part").withColumn("_row", F.col("_base") + F.col("_local"))
    placed = numbers.select(*[F.col(f"`{c}`") for c in docs.columns], "_row")
    places = placed.mapInArrow(_place(starts[-1], shards, seed, ("_row", "_shard", "_slot")), T.StructType([*nullable(placed.schema).fields, T.StructField("_shard", T.IntegerType()), T.StructField("_slot", T.LongType())]))
    places.drop("_row").repartitionByRange(n, "_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
