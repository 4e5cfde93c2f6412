"""Exact deduplication by a log-structured merge index of text digests.

Texts are equal when they are identical after each run of ASCII white space is made one space; null is empty.

* *Memtables.*  Each scan task gathers (digest, id) in a bounded memtable.  When it is full it is flushed as a
  sorted run: one entry for each distinct digest with its smallest id and its count, and a Bloom filter for
  each shard of digests.  Copies within a memtable are merged here, before anything is shuffled.
* *Compaction.*  Runs meet by digest shard and are merged, FAN_IN at a time and level by level.  An entry
  that no other run's filter claims passes through; claimed ones are merged, smallest id and summed count.  More than REGIONS
  shards are reached in steps: runs meet by region first, some REGIONS of them become one run that is cut REGIONS times
  finer, and so on, so that segments of runs stay as long and their number grows with the rows, not with their square.
* *Lookup and verification.*  Every document finds its entry; a hit (an entry whose id is another
  document's) is compared byte by byte with the text of the row that stays.  Hits that differ (two texts,
  one digest) are grouped anew by their whole text, so the result is right for any digest.

Cases: null text is an empty text; empty texts are equal to each other; rows that repeat a doc_id and text are
one group, each reported, and ``deduplicate`` keeps one of them; an empty table gives an empty result; other
columns are passed over, whatever their names; a null doc_id sorts after every other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, dealt, gathered, parallelism, skew_safe_lookup, squeezed

#: Entries a memtable holds before it is flushed; runs merged at a time; filter bits and hashes for each entry.
MEMTABLE_ROWS, FAN_IN, FILTER_BITS, FILTER_HASHES = 1 << 18, 8, 10, 7
#: Most rows expected in a shard of digests; parts into which a run is cut, and runs that become one, at a step.
SHARD_ROWS, REGIONS = 1 << 20, 256
#: Hits compared with one copy of the kept text.
VERIFY_CHUNK = 256
_LAST = (1 << 63) - 1

RUNS = "shard int, run string, filter binary, digest binary, doc_id long, n long"
_RUNS = pa.schema([("shard", pa.int32()), ("run", pa.string()), ("filter", pa.binary()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64())])


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Run:
    """Sorted distinct digests with smallest ids and counts, and a Bloom filter over them."""

    def __init__(self, digest: np.ndarray, ids: np.ndarray, n: np.ndarray, bits: np.ndarray | None = None):
        order = np.argsort(digest, kind="stable")
        digest, ids, n = digest[order], ids[order], n[order]
        first = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]]) if len(digest) else np.zeros(0, np.int64)
        self.digest = digest[first]
        self.ids = np.minimum.reduceat(ids, first) if len(first) else ids
        self.n = np.add.reduceat(n, first) if len(first) else n
        self.bits = make_filter(self.digest) if bits is None else bits


def _positions(digest: np.ndarray, size: int) -> np.ndarray:
    """FILTER_HASHES bit positions of each digest, by double hashing of its first 16 bytes."""
    raw = np.ascontiguousarray(digest).view(np.uint8).reshape(len(digest), -1)[:, :16]
    wide = np.zeros((len(digest), 16), np.uint8)
    wide[:, : raw.shape[1]] = raw
    a, b = wide.view(np.uint64).T
    with np.errstate(over="ignore"):
        return (a + np.arange(FILTER_HASHES, dtype=np.uint64)[:, None] * (b | np.uint64(1))) % np.uint64(size)


def make_filter(digest: np.ndarray) -> np.ndarray:
    size = max(64, (len(digest) * FILTER_BITS + 7) // 8 * 8)
    flat = np.zeros(size, np.uint8)
    if len(digest):
        flat[_positions(digest, size).ravel().astype(np.int64)] = 1
    return np.packbits(flat)


def may_hold(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which digests the filter claims; never false for one it holds."""
    if not len(digest):
        return np.zeros(0, bool)
    at = _positions(digest, len(bits) * 8).astype(np.int64)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def merge(runs: list[Run]) -> Run:
    """Compaction of a few runs: only entries that another run's filter claims are compared."""
    if len(runs) == 1:
        return runs[0]
    shared = [np.zeros(len(r.digest), bool) for r in runs]
    for i, r in enumerate(runs):
        for j, other in enumerate(runs):
            if i != j:
                open_ = np.flatnonzero(~shared[i])
                shared[i][open_[may_hold(other.bits, r.digest[open_])]] = True
    take = lambda mask_of: [np.concatenate([getattr(r, k)[mask_of(s)] for r, s in zip(runs, shared)]) for k in ("digest", "ids", "n")]
    both = Run(*take(lambda s: s), bits=runs[0].bits)
    alone = take(lambda s: ~s)
    return Run(np.concatenate([alone[0], both.digest]), np.concatenate([alone[1], both.ids]), np.concatenate([alone[2], both.n]))


def _keys(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=f"S{width}") if len(column) else np.zeros(0, f"S{width}")


def _emit(run: Run, name: str, shards: int, width: int) -> Iterator[pa.RecordBatch]:
    """A run's entries in digest order, each shard's part behind its filter."""
    shard = shard_of(run.digest, shards)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    raw = run.digest.view(np.uint8).reshape(len(run.digest), width)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[k]), int(cuts[k + 1])
        m = b - a
        bits = make_filter(run.digest[a:b]).tobytes()
        offsets = pa.py_buffer(np.arange(0, (m + 1) * width, width, dtype=np.int32))
        digests = pa.Array.from_buffers(pa.binary(), m, [None, offsets, pa.py_buffer(np.ascontiguousarray(raw[a:b]))])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(m + 1, k, np.int32)), pa.array([name] * (m + 1)), pa.array([bits] + [None] * m, pa.binary()),
            pa.concat_arrays([pa.nulls(1, pa.binary()), digests]),
            pa.array(np.r_[0, run.ids[a:b]]), pa.array(np.r_[0, run.n[a:b]]),
        ], schema=_RUNS)


def shard_of(digest: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the digest's first four bytes, so a sorted run is sorted by shard."""
    raw = digest.view(np.uint8).reshape(len(digest), -1)
    lead = np.zeros(len(digest), np.int64)
    for i in range(4):
        lead = lead << 8 | (raw[:, i] if i < raw.shape[1] else 0)
    return (lead * shards) >> 32


def _flush(memtable_rows: int, shards: int, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, flushed, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            held.append((_keys(batch.column("digest"), width), ids))
            rows += len(ids)
            if rows >= memtable_rows:
                yield from _emit(_table(held), f"{part}-{flushed}", shards, width)
                flushed, held, rows = flushed + 1, [], 0
        if rows:
            yield from _emit(_table(held), f"{part}-{flushed}", shards, width)

    return scan


def _table(held: list[tuple[np.ndarray, np.ndarray]]) -> Run:
    digest, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    return Run(digest, ids, np.ones(len(ids), np.int64), bits=np.zeros(8, np.uint8))


def _compact(width: int, finer: int | None = None):
    """Rows come sorted by shard, pack and run; each pack's runs are merged level by level, to a run in ``finer`` shards or to the index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, run, levels, held, made = None, None, [], None, 0
        part = TaskContext.get().partitionId()

        def close_run():
            if held and held["digest"]:
                put(Run(np.concatenate(held["digest"]), np.concatenate(held["ids"]), np.concatenate(held["n"]), bits=held["bits"]), 0)

        def put(r: Run, level: int):
            while len(levels) <= level:
                levels.append([])
            levels[level].append(r)
            if len(levels[level]) == FAN_IN:
                full, levels[level] = levels[level], []
                put(merge(full), level + 1)

        def close_pack():
            nonlocal made
            rest = [r for level in levels for r in level]
            levels.clear()
            while len(rest) > 1:
                rest = [merge(rest[i : i + FAN_IN]) for i in range(0, len(rest), FAN_IN)]
            if not rest:
                return iter(())
            made += 1
            return _emit(rest[0], f"{part}-{made}", finer, width) if finer else _emit_index(rest[0], place[0], width)

        for batch in batches:
            shards, packs, runs = batch.column("shard").to_numpy(), batch.column("pack").to_numpy(), batch.column("run").to_pylist()
            new = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (packs[1:] != packs[:-1]) | np.array([a != b for a, b in zip(runs[1:], runs[:-1])], bool)]).tolist()
            for a, b in zip(new, [*new[1:], len(runs)]):
                at = int(shards[a]), int(packs[a])
                if (at, runs[a]) != (place, run):
                    close_run()
                    held = None
                    if place is not None and at != place:
                        yield from close_pack()
                    place, run = at, runs[a]
                    held = {"digest": [], "ids": [], "n": [], "bits": None}
                piece = batch.slice(a, b - a)
                if piece.column("filter")[0].is_valid:
                    held["bits"] = np.frombuffer(piece.column("filter")[0].as_py(), np.uint8)
                    piece = piece.slice(1)
                if piece.num_rows:
                    held["digest"].append(_keys(piece.column("digest"), width))
                    held["ids"].append(piece.column("doc_id").to_numpy())
                    held["n"].append(piece.column("n").to_numpy())
        close_run()
        if place is not None:
            yield from close_pack()

    return scan


def _emit_index(run: Run, shard: int, width: int) -> Iterator[pa.RecordBatch]:
    raw = run.digest.view(np.uint8).reshape(len(run.digest), width)
    for a in range(0, len(raw), 65536):
        m = min(65536, len(raw) - a)
        offsets = pa.py_buffer(np.arange(0, (m + 1) * width, width, dtype=np.int32))
        digests = pa.Array.from_buffers(pa.binary(), m, [None, offsets, pa.py_buffer(np.ascontiguousarray(raw[a : a + m]))])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard, np.int32)), digests, pa.array(run.ids[a : a + m]), pa.array(run.n[a : a + m])], ["shard", "digest", "keep_id", "group_size"])


def build_index(ws: Workspace, digests: DataFrame, width: int = 32, memtable_rows: int = MEMTABLE_ROWS, regions: int = REGIONS, shards: int | None = None) -> DataFrame:
    """The compacted index (shard, digest, keep_id, group_size) of (doc_id, digest) rows, one row a digest."""
    shards = shards or max(parallelism(ws.spark), digests.count() // SHARD_ROWS)
    cuts = [min(shards, regions)]
    while cuts[-1] < shards:
        cuts.append(min(shards, cuts[-1] * regions))
    runs = ws.save(digests.select("doc_id", "digest").mapInArrow(_flush(memtable_rows, cuts[0], width), RUNS), "runs-0", by_partition=True)
    for step, finer in enumerate(cuts[1:], 1):
        packs = max(1, runs.select("run").distinct().count() // regions)
        runs = ws.save(_packed(runs, parallelism(ws.spark), packs).mapInArrow(_compact(width, finer), RUNS), f"runs-{step}", by_partition=True)
        ws.drop(f"runs-{step - 1}")
    merged = _packed(runs, min(shards, max(parallelism(ws.spark), shards // 16)), 1).mapInArrow(_compact(width), "shard int, digest binary, keep_id long, group_size long")
    index = ws.save(merged, "index", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
    ws.drop(f"runs-{len(cuts) - 1}")
    return index


def _packed(runs: DataFrame, n: int, packs: int) -> DataFrame:
    """Each shard's segments of runs in ``packs`` packs, each in one task, a run's filter before its entries."""
    packed = runs.withColumn("pack", F.pmod(F.xxhash64("run"), F.lit(packs)).cast("int"))
    return dealt(packed, n, ["shard", "pack"], ["shard", "pack", "run", F.col("filter").isNull(), "digest"])


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest, width: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for every row of ``docs`` (doc_id, text).

    ``digest`` makes ``width`` bytes of the squeezed text; verification makes the result right for any.  Whole texts are
    squeezed and digested once; the ``tie``, a fast hash of the text as it is, finds those that verification reads.
    """
    ws = Workspace(docs.sparkSession, "exact")
    tie = F.xxhash64("text")
    digests = ws.save(docs.select("doc_id", tie.alias("tie"), digest(squeezed(F.col("text"))).alias("digest")), "digests")
    index = build_index(ws, digests, width, memtable_rows)
    found = ws.save(skew_safe_lookup(digests, index.drop("shard"), ["digest"], "group_size"), "found")

    chunks = F.ceil(F.col("group_size") / VERIFY_CHUNK).cast("int")
    several = found.where("group_size > 1").withColumn("_own", F.coalesce("doc_id", F.lit(_LAST)) == F.col("keep_id"))
    hits = several.where("not _own").select("doc_id", "tie", "digest", F.pmod(F.xxhash64("doc_id"), chunks).cast("int").alias("_at"), F.lit(False).alias("_stays")).distinct()
    # of equal rows one is enough; of unlike texts under the smallest id any, as verification parts the others from it
    stays = several.where("_own").groupBy("digest").agg(F.min(F.struct("tie", "doc_id")).alias("_one"), F.max(chunks).alias("_at"))
    stays = stays.select("_one.doc_id", "_one.tie", "digest", "_at", F.lit(True).alias("_stays"))
    same_id = several.where("_own").join(stays.select(F.col("digest").alias("_of"), F.col("tie").alias("_first")), (F.col("digest") == F.col("_of")) & (F.col("tie") != F.col("_first")))
    unlike = same_id.select("doc_id", "tie", "digest", F.lit(0).alias("_at"), F.lit(False).alias("_stays")).distinct()
    wanted = hits.unionByName(unlike).unionByName(stays).withColumnsRenamed({"doc_id": "_id", "digest": "_digest", "tie": "_tie"})
    read = ws.save(
        docs.select("doc_id", "text", tie.alias("tie"))
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
        .select("_id", "_digest", "_tie", "_at", "_stays", "text"), "sides")
    # only now: a test of the digest above would become a key of the join, made for every text
    sides = read.withColumn("_text", squeezed(F.col("text"))).where(digest(F.col("_text")) == F.col("_digest")).drop("text")
    kept_text = sides.where("_stays").groupBy("_digest").agg(F.min("_text").alias("_kept_text"), F.max("_at").alias("_many")).select("_digest", "_kept_text", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)).alias("_at"))
    differs = ws.save(
        sides.where("not _stays").join(kept_text, ["_digest", "_at"]).where(F.col("_text") != F.col("_kept_text"))
        .select("_id", "_digest", "_tie", "_text"), "differs", small=True)
    ws.drop("sides")
    result = found.withColumn("keep_id", F.when(F.col("keep_id") != _LAST, F.col("keep_id")))
    if not differs.isEmpty():
        result = _regroup(ws, result, differs)
    return result.drop("tie").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _regroup(ws: Workspace, result: DataFrame, differs: DataFrame) -> DataFrame:
    """Groups by whole text for hits whose digest is another text's; their old groups shrink by as many."""
    again = differs.groupBy("_digest", "_text").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    moved = differs.join(again, ["_digest", "_text"]).select("_id", "_digest", "_tie", "_keep", "_size").distinct()
    lost = differs.groupBy(F.col("_digest").alias("_from")).agg(F.count(F.lit(1)).alias("_lost"))
    return (
        result.join(moved, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & (F.col("tie") == F.col("_tie")), "left")
        .join(lost, F.col("digest") == F.col("_from"), "left")
        .select("doc_id", "digest", "tie", F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce(F.col("_size"), F.col("group_size") - F.coalesce("_lost", F.lit(0))).alias("group_size"))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    ws = Workspace(docs.sparkSession, "deduplicate")
    kept = ws.save(find_copies(docs).where("kept").groupBy(F.col("doc_id").alias("_exact_id"), F.col("digest").alias("_exact_digest")).agg(F.count(F.lit(1)).alias("_exact_rows")), "kept", small=True)
    left = docs.withColumn("_exact_text", sha256_digest(squeezed(F.col("text")))).join(
        kept.drop("_exact_rows"), F.col("doc_id").eqNullSafe(F.col("_exact_id")) & (F.col("_exact_text") == F.col("_exact_digest")), "left_semi")
    left = gathered(left)
    return (left if kept.where("_exact_rows > 1").isEmpty() else left.dropDuplicates(["doc_id", "_exact_text"])).drop("_exact_text")
