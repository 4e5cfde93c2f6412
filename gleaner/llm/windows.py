"""Exact search for windows of symbols that repeat in a corpus, dealt over a cluster by their minimizers.

A *window* is W consecutive symbols (words or bytes) of one document.  Its *anchor* is the k-gram with the smallest
hash inside it (the leftmost of equals), which depends on the window's content alone, so equal windows have equal
anchors.  Consecutive windows with one anchor form a *part*: a piece of text some W + W/2 symbols long.  Parts meet
by their anchor's hash:

1. ``parts`` are cut from every text by vectorised rolling hashes; parts whose anchor occurs once are dropped.
2. The others' texts (*contents*) are gathered by anchor, copies merged before the shuffle.
3. An index of the caller's kind is built over each shard of whole anchor groups and tells which symbols of each
   content are covered by a window that another content has; a content that itself occurs twice is covered whole.
4. A group of over GROUP contents (a common phrase in many contexts) is first cut finer: its windows are
   split by the anchor's place in the window, and each quarter meets by the hash of all that its windows share.
   At the last step a quarter is one window, so equal parts are one content and no group stays large.
5. Covered spans go back to the documents.

The rolling hashes only bring candidates together; what is covered is decided by the index on the contents themselves, and
for a content that occurs whole several times by its 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, binary_list, dealt, flat_bytes, in_batches, parallelism, skew_safe_lookup

#: Window starts hashed at a time; contents in a group before it is cut finer; symbols of one index shard.
CHUNK, GROUP = 1 << 18, 256
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i below n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        with np.errstate(over="ignore"):
            for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                full = np.full(n, b, np.uint64)
                full[0] = 1
                _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _prefix(codes: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


@dataclass(frozen=True)
class Alphabet:
    """window: symbols of a window; gram: symbols of an anchor."""

    window: int
    gram: int
    words: bool

    @property
    def reach(self) -> int:
        """Places of an anchor in its window."""
        return self.window - self.gram + 1

    def codes(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit code for each symbol and each document's offsets among them."""
        if self.words:
            return word_codes(raw, at)
        return raw, at

    def symbols(self, text: bytes) -> list[bytes] | bytes:
        return text.split() if self.words else text

    def content(self, symbols, a: int, b: int) -> bytes:
        return b" ".join(symbols[a:b]) if self.words else symbols[a:b]

    def length(self, content: bytes) -> int:
        return content.count(b" ") + 1 if self.words else len(content)


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's offsets among them."""
    gap = (raw == 32) | ((raw - np.uint8(9)) <= 4)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.r_[True, gap] | edge
    after = np.r_[gap, True] | edge
    starts = np.flatnonzero(~gap & before[:-1])
    ends = np.flatnonzero(~gap & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_codes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, offsets = word_bounds(raw, at)
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        cuts = np.searchsorted(starts, np.arange(0, len(raw) + CHUNK, CHUNK))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if j > i:
                base = int(starts[i])
                sums = _prefix(_TABLE[raw[base : int(ends[j - 1])]])
                s, e = starts[i:j] - base, ends[i:j] - base
                out[i:j] = _mix((sums[e] - sums[s]) * _powers(len(sums))[1][s] + (e - s).astype(np.uint64))
    return out, offsets


def cut_parts(codes: np.ndarray, offsets: np.ndarray, abc: Alphabet) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, key) of every part; places count within the document."""
    window, gram = abc.window, abc.gram
    first, last = offsets[:-1], offsets[1:] - window  # first and last window start of each document
    found: list[tuple[np.ndarray, ...]] = []
    with np.errstate(over="ignore"):
        for a in range(0, max(0, len(codes) - window + 1), CHUNK):
            own = codes[a : a + CHUNK + window - 1]
            sums = _prefix(own if abc.words else _TABLE[own])
            grams = _mix((sums[gram:] - sums[:-gram]) * _powers(len(sums))[1][: len(sums) - gram])
            n = len(own) - window + 1
            place = np.uint64((1 << 20) - 1)
            low = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), abc.reach) & place
            turn = np.flatnonzero(low[1:] != low[:-1]) + 1
            lo, hi = max(0, int(np.searchsorted(offsets, a, "right")) - 1), int(np.searchsorted(offsets, a + n, "left"))
            own_first, own_end = first[lo:hi] - a, last[lo:hi] + 1 - a
            cuts = np.unique(np.concatenate([turn, own_first, own_end, [0, n]]))
            cuts = cuts[(cuts >= 0) & (cuts <= n)]
            s, e = cuts[:-1], cuts[1:] - 1
            doc = np.searchsorted(offsets, s + a, "right") - 1
            good = s + a <= last[doc]
            s, e, doc = s[good], e[good], doc[good]
            p = low[s].astype(np.int64)
            shift = a - offsets[doc]
            found.append((doc, s + shift, e + shift, p + shift, grams[p].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


PARTS = "key long, row long, doc_id long, lo long, hi long, p long"
CUTS = "key long, digest binary, row long, doc_id long, start long, n long, place int, content binary"
MARKS = "key long, digest binary, n long, low long, size int, spans array<struct<a:int,b:int>>"


def _parts(abc: Alphabet):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "text", 2 << 20):
            raw, at = flat_bytes(batch.column("text"))
            doc, lo, hi, p, key = cut_parts(*abc.codes(raw, at), abc)
            rows, ids = (batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("row", "doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, rows, ids, lo, hi, p)], ["key", "row", "doc_id", "lo", "hi", "p"])

    return scan


def _digest(content: bytes, place: int) -> bytes:
    return hashlib.blake2b(content, digest_size=16, salt=place.to_bytes(4, "little")).digest()


def _cuts(abc: Alphabet):
    """A row for each occurrence and, with n and the text, one for each content of a batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "text", 4 << 20):
            occ: list[tuple] = []
            seen: dict[tuple[int, bytes], list] = {}
            for text, row, doc, parts in zip(binary_list(batch.column("text")), *(batch.column(c).to_pylist() for c in ("row", "doc_id", "parts"))):
                symbols = abc.symbols(text)
                for x in parts:
                    content, place = abc.content(symbols, x["lo"], x["hi"] + abc.window), x["p"] - x["lo"]
                    at = (x["key"], _digest(content, place))
                    occ.append((*at, row, doc, x["lo"]))
                    if (held := seen.get(at)) is None:
                        seen[at] = [doc, 1, place, content]
                    else:
                        held[0], held[1] = min(held[0], doc), held[1] + 1
            m, k = len(occ), len(seen)
            key, digest, row, doc, start = zip(*occ) if occ else [()] * 5
            low, n, place, content = zip(*seen.values()) if seen else [()] * 4
            keys, digests = zip(*seen) if seen else [()] * 2
            yield pa.RecordBatch.from_arrays([
                pa.array([*key, *keys], pa.int64()), pa.array([*digest, *digests], pa.binary()), pa.array([*row, *[None] * k], pa.int64()), pa.array([*doc, *low], pa.int64()),
                pa.array([*start, *[None] * k], pa.int64()), pa.array([*[None] * m, *n], pa.int64()), pa.array([*[None] * m, *place], pa.int32()), pa.array([*[None] * m, *content], pa.binary()),
            ], ["key", "digest", "row", "doc_id", "start", "n", "place", "content"])

    return scan


def _finer(abc: Alphabet, width: int, level: int):
    """Each content's windows by the anchor's place in them, ``width`` places to a part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "content", 1 << 20):
            out: list[tuple] = []
            for x in batch.to_pylist():
                symbols, place = abc.symbols(x["content"]), x["place"]
                starts = len(symbols) - abc.window  # the last window's start
                for q in range(max(0, place - starts) // width, min(place, abc.reach - 1) // width + 1):
                    near, far = q * width, min((q + 1) * width, abc.reach) - 1
                    lo, hi = max(0, place - far), min(starts, place - near)
                    core = abc.content(symbols, place - near, place - far + abc.window)
                    key = xxhash.xxh3_64_intdigest(core, (x["key"] & _M64) ^ (level << 16 | q))
                    content = abc.content(symbols, lo, hi + abc.window)
                    out.append((key - (1 << 64) if key >> 63 else key, _digest(content, place - lo), x["key"], x["digest"], lo, x["n"], x["low"], place - lo, content))
            cols = list(zip(*out)) if out else [()] * 9
            types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "digest", "up_key", "up_digest", "shift", "n", "low", "place", "content"])

    return scan


Index = Callable[[list[bytes], np.ndarray, np.ndarray], list[list[tuple[int, int]]]]


def _index(abc: Alphabet, index: Index, shard_bytes: int):
    """Rows come sorted by key; whole groups are gathered into shards of about ``shard_bytes``."""

    def run(groups: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
        items = list(groups.values())
        contents = [x[2] for x in items]
        key, digest = zip(*groups)
        several = [i for i, x in enumerate(key) if x in key[i - 1 : i] or x in key[i + 1 : i + 2]]  # a content alone has nothing to match
        spans: list = [()] * len(items)
        if several:
            found = index([contents[i] for i in several], *(np.array([items[i][k] for i in several], np.int64) for k in (0, 1)))
            for i, s in zip(several, found):
                spans[i] = s
        return pa.RecordBatch.from_arrays([
            pa.array(key, pa.int64()), pa.array(digest, pa.binary()), pa.array([x[0] for x in items], pa.int64()), pa.array([x[1] for x in items], pa.int64()),
            pa.array([abc.length(c) for c in contents], pa.int32()), pa.array([[{"a": int(a), "b": int(b)} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
        ], ["key", "digest", "n", "low", "size", "spans"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[int, bytes], list] = {}
        size, last = 0, None
        for batch in in_batches(batches, "content", 1 << 20):
            for key, digest, n, low, content in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "n", "low", "content"))):
                if key != last and size >= shard_bytes:
                    yield run(groups)
                    groups, size = {}, 0
                last = key
                if (held := groups.get((key, digest))) is None:
                    groups[key, digest] = [n, low, content]
                    size += len(content)
                else:
                    held[0], held[1] = held[0] + n, min(held[1], low)
        if groups:
            yield run(groups)

    return scan


def _spans(whole, start):
    """Covered spans of an occurrence: the whole content, or those that the index gave, moved to ``start``."""
    moved = F.transform("spans", lambda x: F.struct((x.a + start).alias("a"), (x.b + start).alias("b")))
    return F.when(whole, F.array(F.struct(start.cast("long").alias("a"), (start + F.col("size")).cast("long").alias("b")))).otherwise(moved.cast("array<struct<a:bigint,b:bigint>>"))


def repeated_spans(ws: Workspace, docs: DataFrame, abc: Alphabet, index: Index, by_document: bool, shard_bytes: int, group: int = GROUP) -> DataFrame:
    """(row, spans) for the rows of ``docs`` (row, doc_id, text) with covered symbols.

    by_document: a window counts if it also starts in a document with a smaller doc_id; otherwise if it also
    starts anywhere else.  ``index`` gets distinct contents, how often each occurs and each one's smallest doc_id.
    """
    n = parallelism(ws.spark)
    parts = ws.save(docs.mapInArrow(_parts(abc), PARTS), "parts")
    again = F.col("low") < F.col("high") if by_document else F.col("n") > 1
    keys = ws.save(parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where(again).select("key", "n"), "keys", small=True)
    shared = skew_safe_lookup(parts, keys, ["key"], "n")
    by_row = shared.groupBy("row").agg(F.collect_list(F.struct("key", "lo", "hi", "p")).alias("parts"))
    cuts = ws.save(docs.join(by_row, "row").mapInArrow(_cuts(abc), CUTS), "cuts")
    ws.drop("parts", "keys")

    contents = cuts.where("n is not null").select("key", "digest", "place", "n", F.col("doc_id").alias("low"), "content")
    sizes = ws.save(contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents")), "sizes", small=True)
    large = sizes.where(F.col("contents") > group).select("key")
    marks = _marked(ws, contents, large, abc, index, by_document, shard_bytes, group, n, 0, abc.reach)
    marks = ws.save(marks, "marks")
    occ = cuts.where("n is null").select("key", "digest", "row", "doc_id", "start")
    whole = F.col("doc_id") > F.col("low") if by_document else F.col("n") > 1
    found = skew_safe_lookup(occ, marks, ["key", "digest"], "n").select("row", _spans(whole, F.col("start")).alias("spans")).where(F.size("spans") > 0)
    spans = ws.save(found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans", small=True)
    ws.drop("cuts", "sizes", "marks", *[f"{x}-{i}" for x in ("heavy", "finer", "merged", "fsizes", "fmarks", "fkeys") for i in range(12)])
    return spans


def _marked(ws, contents, large, abc, index, by_document, shard_bytes, group, n, level, width) -> DataFrame:
    """Marks of all contents; groups named in ``large`` are cut finer first, until a part is one window."""
    indexed = lambda df: dealt(df, n, ["key"], ["key"]).mapInArrow(_index(abc, index, shard_bytes), MARKS)
    if width == 1 or large.isEmpty():
        return indexed(contents)
    light = indexed(contents.join(large, "key", "left_anti"))
    heavy = ws.save(
        contents.join(large, "key", "left_semi").groupBy("key", "digest")
        .agg(F.first("place").alias("place"), F.sum("n").alias("n"), F.min("low").alias("low"), F.first("content").alias("content")), f"heavy-{level}", small=True)
    width = -(-width // 4)
    finer = ws.save(
        heavy.repartition(n).mapInArrow(_finer(abc, width, level + 1), "key long, digest binary, up_key long, up_digest binary, shift int, n long, low long, place int, content binary"), f"finer-{level}", small=True)
    again = F.min("low") < F.max("low") if by_document else F.sum("n") > 1
    keys = ws.save(finer.groupBy("key").agg(again.alias("again"), F.count(F.lit(1)).alias("n")).where("again").select("key", "n"), f"fkeys-{level}", small=True)
    merged = ws.save(
        skew_safe_lookup(finer.withColumnRenamed("n", "m"), keys, ["key"], "n").groupBy("key", "digest")
        .agg(F.first("place").alias("place"), F.sum("m").alias("n"), F.min("low").alias("low"), F.first("content").alias("content"), F.count(F.lit(1)).alias("ups")), f"merged-{level}", small=True)
    sizes = ws.save(merged.groupBy("key").agg(F.count(F.lit(1)).alias("contents")), f"fsizes-{level}", small=True)
    marks = _marked(ws, merged.drop("ups"), sizes.where(F.col("contents") > group).select("key"), abc, index, by_document, shard_bytes, group, n, level + 1, width)
    marks = ws.save(marks.join(merged.select("key", "digest", "ups"), ["key", "digest"]), f"fmarks-{level}", small=True)
    up = skew_safe_lookup(finer.select("key", "digest", "up_key", "up_digest", "shift", F.col("low").alias("up_low")), marks, ["key", "digest"], "ups")
    whole = F.col("up_low") > F.col("low") if by_document else F.col("n") > 1
    spans = (
        up.select("up_key", "up_digest", _spans(whole, F.col("shift")).alias("spans")).where(F.size("spans") > 0)
        .groupBy("up_key", "up_digest").agg(F.flatten(F.collect_list("spans")).cast("array<struct<a:int,b:int>>").alias("spans")))
    size = F.size(F.split(F.col("content").cast("string"), " ")) if abc.words else F.octet_length("content")
    back = heavy.join(spans, (F.col("key") == F.col("up_key")) & (F.col("digest") == F.col("up_digest")), "left")
    return light.unionByName(back.select("key", "digest", "n", "low", size.alias("size"), F.coalesce("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)")).alias("spans")))


def numbered(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row is doc_id where those are unique and not null, else a number of the written row.

    A null doc_id counts as larger than any other.
    """
    ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    bare = docs.select("doc_id", "text")
    if ids[0] == ids[1]:
        return bare.select(F.col("doc_id").alias("row"), "doc_id", "text")
    return ws.save(bare.select(F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text"), "rows")


def cover(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Disjoint sorted spans of the union."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
