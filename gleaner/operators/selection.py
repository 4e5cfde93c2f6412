"""Greedy choice of the best collective set.

A candidate's value is the weighted sum of eight terms, added in a fixed order.  Four of them fall as the chosen set
grows and the others are constant, so an old value is an upper bound of the new one, and lazy evaluation (Minoux, 1978)
picks exactly what a full rescan would.  Collections are independent; one of up to KERNEL_ROWS candidates is done
by one task, a larger one by one distributed scan for each pick.  Equal values go to the smaller path.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_or_zero
from ..plans.policy import TERMS, Choice
from ..sources.store import Tables

KERNEL_ROWS = 200_000
BUCKETS = ("pose", "expression", "appearance", "scene", "session")
PICKED = "collection string, path string, pick int, value double, " + ", ".join(f"{t}_part double" for t in TERMS)


def _sixth(x: np.ndarray) -> np.ndarray:
    """Rounded half up to six places, so that equal vectors compare equal in any engine."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def greedy(pdf: pd.DataFrame, weights: Sequence[float], target: int, forced: Sequence[str] = ()) -> list[tuple[int, float, tuple[float, ...]]]:
    """(row, value, terms) of each pick in order; ``pdf`` has path, quality, match, the buckets and vec."""
    n = len(pdf)
    target = min(target, n)
    path = pdf["path"].tolist()
    place = {p: i for i, p in enumerate(path)}
    missing = [p for p in forced if p not in place]
    if missing or len(forced) > max(target, 0):
        raise ValueError("forced items must be candidates, and no more than the target")
    quality, match = pdf["quality"].to_numpy(float), pdf["match"].to_numpy(float)
    keys = [[x if x else "unknown" for x in pdf[b].tolist()] for b in BUCKETS]
    vectors = [np.asarray(v if v is not None else [], float) for v in pdf["vec"]]
    width = max([len(v) for v in vectors], default=0)
    units = np.zeros((n, width))
    for i, v in enumerate(vectors):
        length = float(np.sqrt((v * v).sum()))
        if length:
            units[i, : len(v)] = v / length
    nearest, seen = np.zeros(n), [Counter() for _ in BUCKETS]

    def terms(i: int) -> tuple[float, ...]:
        return (quality[i], match[i], 1.0 - nearest[i], *(1.0 / (1.0 + c[k[i]]) for c, k in zip(seen, keys)))

    def value(t: tuple[float, ...]) -> float:
        total = 0.0
        for w, x in zip(weights, t):
            total += w * x
        return total

    picks: list[tuple[int, float, tuple[float, ...]]] = []
    chosen = np.zeros(n, bool)

    def choose(i: int) -> None:
        t = terms(i)
        picks.append((i, value(t), t))
        chosen[i] = True
        np.maximum(nearest, _sixth(units @ units[i]), out=nearest)
        for c, k in zip(seen, keys):
            c[k[i]] += 1

    for p in forced:
        choose(place[p])
    heap = [(-value(terms(i)), path[i], i, len(picks)) for i in range(n) if not chosen[i]]
    heapq.heapify(heap)
    while len(picks) < target and heap:
        _, p, i, when = heapq.heappop(heap)
        if when == len(picks):
            choose(i)
        else:
            heapq.heappush(heap, (-value(terms(i)), p, i, len(picks)))
    return picks


def _kernel(weights: Sequence[float], target: int, forced: Sequence[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [p for p in forced if p in set(pdf["path"])]
        rows = [(pdf["collection"].iloc[i], pdf["path"].iloc[i], k + 1, round(v * 100, 3), *(round(w * x * 100, 3) for w, x in zip(weights, t))) for k, (i, v, t) in enumerate(greedy(pdf, weights, target, own))]
        return pd.DataFrame(rows, columns=["collection", "path", "pick", "value", *[f"{t}_part" for t in TERMS]])

    return run


def select(candidates: DataFrame, choice: Choice, forced: Sequence[str] = (), kernel_rows: int = KERNEL_ROWS) -> DataFrame:
    """(collection, path, pick, value and its parts) of the chosen; ``forced`` paths come first, in their order.

    ``candidates``: collection, path, quality, match, the five buckets and vec.  A target of 0 or less chooses none.
    """
    spark = candidates.sparkSession
    tables = Tables(spark, "select")
    rows = tables.save(candidates.select("collection", "path", "quality", "match", *BUCKETS, "vec"), "candidates")
    sizes = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    if forced:
        known = {r.path for r in rows.where(F.col("path").isin(*forced)).select("path").collect()}  # as many as were forced
        if len(known) < len(set(forced)) or len(forced) > choice.count:
            raise ValueError("forced items must be candidates, and no more than the target")
    large = [r.collection for r in sizes.where(F.col("n") > kernel_rows).collect()]  # fewer than rows / kernel_rows
    is_large = F.when(F.col("collection").isNull(), None in large).otherwise(F.col("collection").isin(*[x for x in large if x is not None]))
    small = rows.where(~is_large) if large else rows
    out = small.groupBy("collection").applyInPandas(_kernel(choice.weights, choice.count, list(forced)), PICKED)
    for i, name in enumerate(large):
        out = out.union(_by_scans(tables, rows.where(F.col("collection").eqNullSafe(name)), choice, forced, f"large-{i}"))
    return out


def _by_scans(tables: Tables, rows: DataFrame, choice: Choice, forced: Sequence[str], name: str, keep: int = 8) -> DataFrame:
    """The same picks by one distributed maximum for each; similarities so far are written every ``keep`` picks."""
    spark = rows.sparkSession
    state, fresh, chosen, counts, picks = tables.save(rows.withColumn("near", F.lit(0.0)), f"{name}-0"), [], [], [Counter() for _ in BUCKETS], []
    own = {r.path for r in rows.where(F.col("path").isin(*forced)).select("path").collect()} if forced else set()  # as many as were forced
    left = [p for p in forced if p in own]
    total, collection = rows.count(), rows.first().collection
    key = lambda b: F.when(F.coalesce(b, F.lit("")) == "", "unknown").otherwise(F.col(b))
    while len(picks) < min(choice.count, total):
        near = F.greatest("near", *[F.round(cosine_or_zero(F.col("vec"), F.array(*[F.lit(float(x)) for x in v])), 6) for v in fresh]) if fresh else F.col("near")
        novelty = []
        for b, c in zip(BUCKETS, counts):
            term: Column = F.lit(1.0)
            for k, n in c.items():
                term = F.when(key(b) == k, 1.0 / (1.0 + n)).otherwise(term)
            novelty.append(term)
        terms = [F.col("quality"), F.col("match"), 1.0 - near, *novelty]
        value = F.lit(0.0)
        for w, t in zip(choice.weights, terms):
            value = value + w * t
        open_ = state.where(~F.col("path").isin(*chosen)) if chosen else state
        if left:
            open_ = open_.where(F.col("path") == left.pop(0))
        best = open_.select("path", "vec", *[key(b).alias(b) for b in BUCKETS], value.alias("value"), *[t.alias(f"{n}_t") for n, t in zip(TERMS, terms)]).orderBy(F.desc("value"), "path").first()
        picks.append((collection, best.path, len(picks) + 1, round(best.value * 100, 3), *[round(w * best[f"{n}_t"] * 100, 3) for w, n in zip(choice.weights, TERMS)]))
        chosen.append(best.path)
        if best.vec:
            fresh.append(list(best.vec))
        for b, c in zip(BUCKETS, counts):
            c[best[b]] += 1
        if len(fresh) == keep:
            step = len(picks)
            near = F.greatest("near", *[F.round(cosine_or_zero(F.col("vec"), F.array(*[F.lit(float(x)) for x in v])), 6) for v in fresh])
            state, fresh = tables.save(state.withColumn("near", near), f"{name}-{step}"), []
    return spark.createDataFrame(picks, PICKED)


def decided(items: DataFrame, picks: DataFrame) -> DataFrame:
    """Every item with decision, reason_code, pick and value: gate and duplicate reasons stay, the rest is chosen or redundant."""
    joined = items.join(picks.select("path", "pick", "value"), "path", "left")
    code = F.when(F.col("pick").isNotNull(), F.lit(None).cast("string")).when(F.col("reason_code").isNotNull(), F.col("reason_code")).otherwise("REDUNDANT")
    return joined.withColumn("decision", F.when(F.col("pick").isNotNull(), "selected").otherwise("rejected")).withColumn("reason_code", code)
