"""64-bit perceptual hashes as 16 hex digits, and as two 32-bit halves for arithmetic."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def high(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def low(h: Column) -> Column:
    return F.conv(F.substring(h, 9, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes."""
    return (F.bit_count(high(a).bitwiseXOR(high(b))) + F.bit_count(low(a).bitwiseXOR(low(b)))).cast("int")


def packed(h: Column) -> Column:
    """The hash as one signed 64-bit number."""
    return F.shiftleft(high(h), 32).bitwiseOR(low(h))


def unpacked(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def hex_halves(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 8, "0"), F.lpad(F.hex(lo), 8, "0")))


def average_hash(tile: Column) -> Column:
    """Hash of a tile of 64 values: a bit is 1 where the value is at least the mean; the first is the highest bit."""
    mean = F.aggregate(tile, F.lit(0.0), lambda s, x: s + x) / 64
    # a repeated number: inside a lambda the mean would be computed for each element
    bits = F.zip_with(tile, F.array_repeat(mean, 64), lambda x, m: F.when(x >= m, 1).otherwise(0))
    fold = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 2 + x)
    return hex_halves(fold(F.slice(bits, 1, 32)), fold(F.slice(bits, 33, 32)))


def word_hash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash): 64 buckets of words by MD5, a bit where a bucket has at least the mean count."""
    words = df.select(key, F.explode(F.split(text, " ")).alias("w"))
    bucket = F.pmod(F.conv(F.substring(F.md5("w"), 1, 2), 16, 10).cast("int"), F.lit(64))
    counts = words.groupBy(key, bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    bits = lambda first: F.sum(F.when(F.col("set") & F.col("b").between(first, first + 31), F.expr(f"shiftleft(1L, {first} + 31 - b)")).otherwise(F.lit(0).cast("long")))
    total = counts.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct("b", "n")).alias("found"))  # 64 at most
    flat = total.select(key, "total", F.inline("found")).withColumn("set", F.col("n") * 64 >= F.col("total"))
    return flat.groupBy(key).agg(bits(0).alias("hi"), bits(32).alias("lo")).select(key, hex_halves(F.col("hi"), F.col("lo")).alias("hash"))


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of radius + 1 disjoint blocks from the low bit up; the first are one bit wider."""
    if not 0 <= radius <= 16:
        raise ValueError("a radius from 0 to 16 is needed: blocks get too narrow beyond")
    width, wider = divmod(64, radius + 1)
    out, at = [], 0
    for i in range(radius + 1):
        w = width + (i < wider)
        out.append((at, w))
        at += w
    return out


def block_keys(h: Column, radius: int) -> Column:
    """An array of (block, key): hashes within the radius share one at least."""
    hi, lo = high(h), low(h)
    keys = []
    for i, (at, w) in enumerate(block_bounds(radius)):
        if w == 64:
            value = h
        elif at >= 32:
            value = F.shiftright(hi, at - 32).bitwiseAND((1 << w) - 1).cast("string")
        elif at + w <= 32:
            value = F.shiftright(lo, at).bitwiseAND((1 << w) - 1).cast("string")
        else:
            value = F.shiftright(lo, at).bitwiseOR(F.shiftleft(hi.bitwiseAND((1 << (at + w - 32)) - 1), 32 - at)).cast("string")
        keys.append(F.struct(F.lit(i).alias("block"), value.alias("key")))
    return F.array(*keys)


def piece_masks(pieces: int) -> list[int]:
    """The 64 bits cut into pieces of nearly equal width, each as a signed 64-bit mask."""
    cuts = [round(64 * i / pieces) for i in range(pieces + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def piece_scheme(hashes: int, radius: int, most: int = 6) -> tuple[int, int]:
    """(pieces, pieces in a key) that give ``hashes`` distinct hashes the least work: rows to shuffle and candidates to compare.

    Hashes within ``radius`` bits differ in that many of radius + k pieces at most, so they agree on some choice of k pieces.
    A row counts as ROW_COST candidates.
    """
    def work(k: int) -> float:
        return comb(radius + k, k) * (ROW_COST * hashes + hashes * hashes / 2 ** (1 + 64 * k / (radius + k)))

    best = min(range(1, most + 1), key=work)
    return radius + best, best


#: Candidates that take as long to compare as one keyed row takes to make and shuffle.
ROW_COST = 20


def piece_keys(number: Column, pieces: int, agree: int) -> Column:
    """An array of (pick, below, part): for each choice of pieces its bit mask, all pieces up to its last one, and the hash's bits there."""
    masks, keys = piece_masks(pieces), []
    for choice in combinations(range(pieces), agree):
        mask = sum(masks[i] for i in choice)
        keys.append(F.struct(F.lit(sum(1 << i for i in choice)).alias("pick"), F.lit((2 << choice[-1]) - 1).alias("below"), number.bitwiseAND(F.lit(mask)).alias("part")))
    return F.array(*keys)


def agreed(difference: Column, pieces: int) -> Column:
    """The pieces, as a bit mask, in which two hashes with this exclusive or agree."""
    out = F.lit(0)
    for i, mask in enumerate(piece_masks(pieces)):
        out = out + F.when(difference.bitwiseAND(F.lit(mask)) == 0, 1 << i).otherwise(0)
    return out
