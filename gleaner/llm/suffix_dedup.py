"""Removal of long byte strings that repeat anywhere, by run-length Burrows-Wheeler indexes.

Each byte covered by a string of LENGTH bytes that also starts anywhere else, in the same document or another, is
removed; occurrences may overlap, strings never cross documents and are judged on the input.

Texts meet by the minimizers of windows.py.  For each shard a run-compressed Burrows-Wheeler transform is built over
its distinct contents, with the suffix-array samples at the runs' ends.  Only at those ends can the longest
match of a suffix with its neighbour in sorted order be new; from there the matching statistics of all positions
stream in text order, one less at each byte (Karkkainen, Manzini and Puglisi, CPM 2009; Gagie, Navarro and Prezza,
SODA 2018).  A position whose statistic reaches LENGTH starts a repeated string.

Cases: null text is empty; texts shorter than LENGTH stay whole; rows that repeat a doc_id are texts of their own; an
empty table gives an empty result; cutting may split a UTF-8 character, so what is left is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, binary_list, gathered, in_batches
from .windows import LAST, Alphabet, cover, numbered, repeated_spans

LENGTH, GRAM = 400, 145
SHARD_BYTES = 1 << 16


class RunLengthBWT:
    """The run-compressed transform of a few texts, each ended by a separator of its own.

    heads, lengths: the runs; first, last: suffix-array samples at each run's two ends; before, after: the
    longest match of those suffixes with their neighbour outside the run.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.ends = np.cumsum(sizes) - 1
        self.starts = self.ends - sizes + 1
        sym = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + len(texts)
        sym[self.ends] = np.arange(len(texts))
        self.size = n = len(sym)
        ranks, steps = self._ranks(sym)
        sa = np.empty(n, np.int64)
        sa[ranks[-1]] = np.arange(n)
        bwt = sym[sa - 1]
        turn = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        begin = np.r_[0, turn]
        self.heads, self.lengths = bwt[begin], np.diff(np.r_[begin, n])
        self.first, self.last = sa[begin], sa[np.r_[turn, n] - 1]
        self.before = np.r_[0, self._common(sym, ranks, steps, sa[turn - 1], sa[turn])]
        self.after = np.r_[self.before[1:], 0]

    @staticmethod
    def _ranks(sym: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """Ranks of all suffixes by their first m, 2m, 4m and so on symbols, m as many as a number holds, until they differ."""
        n, width = len(sym), int(sym.max() + 1).bit_length()
        step = 62 // width
        both = np.zeros(n, np.int64)
        for i in range(min(step, n)):  # past the end counts as less than any symbol
            both[: n - i] |= (sym[i:] + 1) << (width * (step - 1 - i))
        ranks, steps = [], []
        while True:
            order = np.argsort(both)
            in_order = both[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, in_order[1:] != in_order[:-1]])
            ranks.append(new)
            steps.append(step)
            if new[order[-1]] == n - 1:
                return ranks, steps
            both = new * (n + 1)
            both[: n - step] += new[step:] + 1
            step *= 2

    @staticmethod
    def _common(sym: np.ndarray, ranks: list[np.ndarray], steps: list[int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common prefix of suffixes a[i] and b[i], by the ranks of their first symbols."""
        a, b, out, n = a.copy(), b.copy(), np.zeros(len(a), np.int64), len(sym)
        for rank, step in [*zip(ranks[-2::-1], steps[-2::-1]), *[(sym, 1)] * (steps[0] - 1)]:
            same = (a < n) & (b < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            out, a, b = out + same * step, a + same * step, b + same * step
        return out

    def statistics(self) -> np.ndarray:
        """For each position, the longest match that also starts anywhere else."""
        return np.maximum(self._stream(self.first, self.before), self._stream(self.last, self.after))

    def _stream(self, at: np.ndarray, match: np.ndarray) -> np.ndarray:
        """Sampled matches carried on in text order: one less at each position, until the next sample."""
        sums = np.full(self.size, -1, np.int64)
        sums[at] = match + at
        held = np.maximum.accumulate(np.where(sums >= 0, np.arange(self.size), 0))
        return np.maximum(sums[held] - np.arange(self.size), 0)


def shard_index(length: int):
    """The index of one shard: maximal runs of each content covered by strings that occur elsewhere in it."""

    def index(contents: list[bytes], n: np.ndarray, low: np.ndarray) -> list[list[tuple[int, int]]]:
        bwt = RunLengthBWT(contents)
        hits = np.flatnonzero(bwt.statistics() >= length)
        text = np.searchsorted(bwt.starts, hits, "right") - 1
        new = np.r_[True, (hits[1:] > hits[:-1] + length) | (text[1:] != text[:-1])] if len(hits) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(hits)] - 1
        out: list[list[tuple[int, int]]] = [[] for _ in contents]
        for t, a, b in zip(text[begin].tolist(), (hits[begin] - bwt.starts[text[begin]]).tolist(), (hits[end] - bwt.starts[text[end]]).tolist() if len(begin) else []):
            out[t].append((a, b + length))
        return out

    return index


def repeated_in_corpus(ws: Workspace, rows: DataFrame, length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """(row, spans of bytes) that start elsewhere too; ``rows``: (row, doc_id, text)."""
    return repeated_spans(ws, rows, Alphabet(length, gram, False), shard_index(length), False, SHARD_BYTES, **options)


KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<a:bigint,b:bigint>>, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_batches(batches, "text", 4 << 20):
        kept, gone, spans, sums = [], [], [], []
        texts = binary_list(batch.column("text"))
        for text, covered in zip(texts, batch.column("spans").to_pylist()):
            found = cover(covered, len(text))
            spans.append([{"a": a, "b": b} for a, b in found])
            gone.append(sum(b - a for a, b in found))
            edges = [0, *(x for s in found for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            sums.append(hashlib.sha256(kept[-1]).hexdigest())
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(sums)], ["doc_id", "kept", "n_bytes", "n_removed", "spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """(doc_id, remaining bytes, n_bytes, n_removed, spans, kept_sha256) for every row of ``docs``."""
    ws = Workspace(docs.sparkSession, "suffix")
    rows = numbered(ws, docs)
    spans = repeated_in_corpus(ws, rows, length, gram, **options)
    return gathered(rows.join(spans, "row", "left")).select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "text", "spans").mapInArrow(_remove, KEPT)
