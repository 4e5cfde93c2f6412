"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

*Targets.*  Sources share the words of all documents by weight; a target stops at REPEATS times its source's
size and the excess is shared by weight among the others until none is above.

*Quotas.*  Each source's documents are permuted by a keyed hash and cut into blocks, equal ranges of that order, of about
BLOCK_WORDS words.  A source's blocks are drawn in this order, pass after pass; its quota is the number of draws that its
target takes.  The last draws are trimmed to the documents that end nearest to the target, so no document is taken
more than REPEATS times.

*Splitting tree.*  The sources' quotas are split exactly among the output shards: at each node of a
binary tree over the shards, how many draws of each source go left is one multivariate-hypergeometric sample with a seed
of its own.  A shard's share of a source is a range of that source's draws, so shards are disjoint, and a block is in the mix
as often as the tree hands one of its draws to a shard.  In a shard, rows are shuffled by a keyed hash.

The driver holds one row for each source and its count in each shard, at most CELLS counts (but MIN_SHARDS for each
source), never documents; tasks get these counts by one broadcast and find a draw's shard by binary search.  Reruns agree,
whatever the partitions.  Cases: null text has no words; a null source is a source, last in order; documents without
words are taken with their block and count nothing; rows that repeat doc_id, text and source are drawn alike; an empty
table gives an empty result; columns may have any name but those that start with _mix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, dealt, gathered, parallelism, ranked_sums

WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, 42
BLOCK_WORDS, SHARD_WORDS, MIN_SHARDS = 100_000, 8_000_000, 16
#: Equal rows that are written out at a time.
ROWS_AT_ONCE = 4096
#: Most counts (shards times sources) that are broadcast; beyond it shards are larger.
CELLS = 1 << 20
#: Times that smaller documents fill what a larger one left open.
REFILLS = 1
#: Documents that top up a source at most, nearest size first; each takes up most of what is missing.
TOPS = 6
TOP = "top_source string, top_key long, top_id long, top_tie long"


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: float = REPEATS) -> list[float]:
    """Each source's words in the mix."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / total > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Draws of each source (columns) in each shard (rows); column sums are the quotas, row sums at most one apart."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        mid, total = (low + high) // 2, int(counts.sum())
        left = total * (mid - low) // (high - low)
        own = np.random.default_rng([seed, low, high])
        taken = own.multivariate_hypergeometric(counts, left, method="marginals") if total else counts
        split(taken, low, mid)
        split(counts - taken, mid, high)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def shard_count(words: int, sources: int) -> int:
    """Shards of about SHARD_WORDS words, as many as CELLS allows."""
    return max(MIN_SHARDS, min(-(-words // SHARD_WORDS), CELLS // max(1, sources)))


DRAWN = "doc_id long, tie long, source string, size long, n long, source_size long, target double, draws array<struct<pass:int,block:long,shard:int,place:long>>"


def _draw(ends: Broadcast, seed: int):
    """The draws of each row: those of its block that the tree gave to a shard, the trimmed last ones only if they are ``extra``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = ends.value
        for batch in batches:
            place, passes, blocks, block, final, key = (batch.column(c).to_numpy() for c in ("place", "passes", "blocks", "block", "final", "key"))
            extra = batch.column("extra").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(place)), passes + 1)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(passes + 1) - passes - 1, passes + 1)
            last = turn == passes[row]
            own = np.where(last & extra[row], np.minimum(block[row], final[row]), block[row])  # a topping joins the last block
            number = turn * blocks[row] + own
            shard = np.empty(len(row), np.int64)
            for k in np.unique(place).tolist():
                at = np.flatnonzero(place[row] == k)
                shard[at] = np.searchsorted(counts[:, k], number[at], "right")
            taken = (shard < len(counts)) & (~last | extra[row])
            row, turn, own, shard = row[taken], turn[taken], own[taken], shard[taken]
            with np.errstate(over="ignore"):
                mixed = (key[row].view(np.uint64) ^ (turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))) * np.uint64(0xD6E8FEB86659FD93)
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            draws = pa.StructArray.from_arrays([pa.array(turn.astype(np.int32)), pa.array(own), pa.array(shard.astype(np.int32)), pa.array((mixed ^ (mixed >> np.uint64(29))).view(np.int64))], ["pass", "block", "shard", "place"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(place) + 1)).astype(np.int32)), draws)
            names = ("doc_id", "tie", "source", "size", "n", "source_size", "target")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], [*names, "draws"])

    return scan


def units(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, block_words: int = BLOCK_WORDS, shards: int | None = None) -> DataFrame:
    """(doc_id, tie, source, size, n, source_size, target, draws): one row for the n rows of ``docs`` that have doc_id, text and source alike.

    draws: a struct (pass, block, shard, place) for each time these rows are taken; ``place`` orders a shard's rows.
    """
    ws = Workspace(docs.sparkSession, "mix")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    bare = docs.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("tie"))
    rows = ws.save(bare.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("n")).withColumns({"key": F.xxhash64(F.lit(seed), "doc_id", "tie"), "words": F.col("n") * F.col("size")}), "rows", small=True)
    found = rows.groupBy("source").agg(F.sum("words").alias("size")).collect()  # one row for each source
    found.sort(key=lambda r: (r.source is None, [ord(c) for c in r.source or ""]))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], repeats)
    passes = [min(repeats, int(t // s)) if s else 0 for t, s in zip(goal, sizes)]
    blocks = [max(1, min(s // block_words, 1 << 31)) for s in sizes]
    table = [(r.source, i, s, t, p, t - p * s, b) for i, (r, s, t, p, b) in enumerate(zip(found, sizes, goal, passes, blocks))]
    sources = ws.spark.createDataFrame(table, "of string, place int, source_size long, target double, passes int, rest double, blocks long")
    known = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")  # one row for each source
    block = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * F.col("blocks"), 32)
    # the permuted order: a document of the last pass is taken if it ends before the target
    drawn = ws.save(
        ranked_sums(known, ["source"], "key", "words", "before").withColumn("block", block)
        .withColumn("extra", (F.col("rest") > 0) & (F.col("before") + F.col("words") <= F.col("rest"))), "drawn", small=True)
    gap = _missing(drawn, found, goal, passes)
    for step in range(REFILLS):  # documents that fit into what a larger one left open, in the same order
        gaps = ws.spark.createDataFrame(list(gap.items()), "of string, gap double")
        fits = drawn.join(F.broadcast(gaps), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        fits = fits.withColumn("fit", F.when(~F.col("extra") & (F.col("words") <= F.col("gap")), F.col("words")).otherwise(0))
        more = (F.col("fit") > 0) & (F.col("ahead") + F.col("fit") <= F.col("gap"))
        drawn = ws.save(ranked_sums(fits, ["source"], "key", "fit", "ahead").withColumn("extra", F.col("extra") | more).drop("fit", "ahead", "gap"), f"drawn-{step}", small=True)
        gap = _missing(drawn, found, goal, passes)
    ended = {r.source: r.n for r in drawn.where("extra").groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}  # one row for each source
    tops: list[tuple] = []  # at most TOPS documents for each source
    for step in range(TOPS):
        gaps = ws.spark.createDataFrame(list(gap.items()), "of string, gap double")
        left = drawn.where("not extra and words > 0").join(F.broadcast(gaps), F.col("source").eqNullSafe(F.col("of"))).where("words <= gap" if step < TOPS - 1 else "abs(gap - words) < gap")  # the last may go over, if that is nearer
        if tops:
            left = left.join(F.broadcast(ws.spark.createDataFrame(tops, TOP).drop("top_source")), F.col("key") == F.col("top_key"), "left_anti")
        nearest = F.struct(F.abs(F.col("gap") - F.col("words")).alias("miss"), "key", "doc_id", "tie", "words")
        new = left.groupBy("source").agg(F.min(nearest).alias("top")).collect()
        tops += [(r.source, r.top.key, r.top.doc_id, r.top.tie) for r in new]
        for r in new:
            gap[r.source] = max(0.0, gap[r.source] - r.top["words"])
    topped = {t[0] for t in tops}
    used = {r.source: max(ended.get(r.source, 0), int(r.source in topped)) for r in found}
    quotas = np.array([p * b + used[r.source] for r, p, b in zip(found, passes, blocks)], np.int64)
    many = shards or shard_count(sum(sizes), len(found))
    ends = np.cumsum(split_quotas(quotas, many, seed), axis=0) if len(found) else np.zeros((many, 0), np.int64)
    finals = ws.spark.createDataFrame([(r.source, used[r.source] - 1) for r in found], "of string, final long")
    rated = drawn.join(F.broadcast(finals), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    own_top = F.col("key").eqNullSafe(F.col("top_key")) & F.col("source").eqNullSafe(F.col("top_source")) & F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie"))
    rated = rated.join(F.broadcast(ws.spark.createDataFrame(tops, TOP).distinct()), own_top, "left").withColumn("extra", F.col("extra") | F.col("top_key").isNotNull())
    asked = rated.select("doc_id", "tie", "source", "size", "n", "source_size", "target", "place", "passes", "blocks", "block", "final", "key", "extra")
    return gathered(asked, 1).mapInArrow(_draw(ws.spark.sparkContext.broadcast(ends), seed), DRAWN)


def plan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, draws) for every row of ``docs`` (doc_id, text, source); see ``units``."""
    rows = units(docs, **options)
    step = F.lit(ROWS_AT_ONCE)
    whole = rows.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step.cast("long"))))
    return whole.withColumn("_row", F.explode(F.sequence(F.col("_at"), F.least(F.col("n"), F.col("_at") + step) - 1))).drop("_at", "_row", "n", "tie")


def _missing(drawn: DataFrame, found: list, goal: list[float], passes: list[int]) -> dict[str | None, float]:
    """Words that each source still lacks; one row for each source is collected."""
    taken = {r.source: r.words for r in drawn.where("extra").groupBy("source").agg(F.sum("words").alias("words")).collect()}
    return {r.source: max(0.0, t - p * r["size"] - taken.get(r.source, 0)) for r, t, p in zip(found, goal, passes)}


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every column of ``docs``, a row for each time it is taken, and _mix_shard and _mix_place."""
    names = {"doc_id": "_mix_id", "tie": "_mix_tie", "source": "_mix_source", "draws": "_mix_draws"}
    draws = units(docs, **options).where(F.size("draws") > 0).select(*[F.col(k).alias(v) for k, v in names.items()])
    own = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_own") == F.col("_mix_tie")) & F.col("source").eqNullSafe(F.col("_mix_source"))
    taken = docs.withColumn("_mix_own", F.xxhash64("text")).join(draws, own)
    drawn = taken.withColumn("_mix_draw", F.explode("_mix_draws")).withColumns({"_mix_shard": F.col("_mix_draw.shard"), "_mix_place": F.col("_mix_draw.place")})
    return gathered(drawn).drop("_mix_own", "_mix_draw", *names.values())


def shuffled(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``: the mixed rows by shard and, in a shard, in the shuffled order; a shard's places are cut into 64 ranges."""
    mixed = mix(docs, **options).withColumn("_mix_range", F.shiftrightunsigned("_mix_place", 58))
    n = parallelism(docs.sparkSession)
    return dealt(mixed, n, ["_mix_shard", "_mix_range"], ["_mix_shard", F.shiftrightunsigned("_mix_place", 1)]).drop("_mix_shard", "_mix_place", "_mix_range")


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """The mix as Parquet folders _mix_shard=k, each shuffled and, if large, in several files."""
    mixed = mix(docs, **options).withColumn("_mix_range", F.shiftrightunsigned("_mix_place", 58))
    n = parallelism(docs.sparkSession)
    dealt(mixed, n, ["_mix_shard", "_mix_range"], ["_mix_shard", F.shiftrightunsigned("_mix_place", 1)]).drop("_mix_range").write.partitionBy("_mix_shard").parquet(path)
