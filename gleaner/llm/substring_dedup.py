"""Removal of passages that repeat across documents, by suffix automata of reference shards.

A window of WINDOW words of a document is repeated if its word sequence also starts in a document with a smaller
doc_id; each word covered by a repeated window is removed.  Windows are judged on the input.

Two ways share one automaton (each state knows the smallest document its strings occur in):

* ``remove_known``: the references are another, small table.  Their shards' automata are broadcast, after a check of
  their total size against BROADCAST_BYTES, and all documents stream through them.
* ``repeated_in_corpus``: every document is a reference for the later ones.  Automata of the whole corpus
  can't be broadcast, so candidates and references meet by the minimizers of windows.py: each task builds the
  automata of its own shards, at most SHARD_BYTES of distinct text each, and streams the same shard's contents.

Cases: null or empty texts have no word; texts with fewer words than a window stay whole; equal doc_ids never remove
each other's words; a null doc_id counts as the largest; an empty table gives an empty result.
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

WINDOW, GRAM = 50, 19
SHARD_BYTES = 1 << 19
BROADCAST_BYTES = 16 << 20


class SuffixAutomaton:
    """A generalised suffix automaton over words; ``low`` is the smallest document of each state's strings."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [LAST]
        self.ready = True

    def _copy(self, p: int, word: bytes, q: int) -> int:
        """The state that ``p`` reaches by ``word`` alone; ``q``, which also holds longer strings, is split if need be."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.low.append(LAST)
        self.link[q] = clone
        step = self.next
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        step, link, length, low, last = self.next, self.link, self.length, self.low, 0
        for word in words:
            q = step[last].get(word)
            if q is not None:
                last = self._copy(last, word, q)
            else:
                new = len(step)
                step.append({})
                length.append(length[last] + 1)
                link.append(0)
                low.append(LAST)
                p = last
                while p >= 0 and word not in step[p]:
                    step[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._copy(p, word, step[p][word])
                last = new
            if doc < low[last]:
                low[last] = doc
        self.ready = False

    def close(self) -> SuffixAutomaton:
        """Hand each state's document on to the states of its suffixes."""
        low, link = self.low, self.link
        for v in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            if low[v] < low[link[v]]:
                low[link[v]] = low[v]
        self.ready = True
        return self

    def statistics(self, words: list[bytes], most: int) -> Iterator[tuple[int, int]]:
        """For each word: the length of the longest match that ends there, ``most`` at most, and the smallest document of it."""
        assert self.ready, "close() comes first"
        step, link, length, low = self.next, self.link, self.length, self.low
        v = n = 0
        for word in words:
            while v and word not in step[v]:
                v = link[v]
                n = length[v]
            q = step[v].get(word)
            if q is not None:
                v, n = q, n + 1
                if n > most:
                    n = most
                while v and length[link[v]] >= most:
                    v = link[v]
            else:
                n = 0
            yield n, low[v]


def matched_spans(automaton: SuffixAutomaton, words: list[bytes], window: int, before: int) -> list[tuple[int, int]]:
    """Maximal spans covered by windows that the automaton has in a document smaller than ``before``."""
    out: list[list[int]] = []
    for i, (n, low) in enumerate(automaton.statistics(words, window)):
        if n == window and low < before:
            if out and i + 1 - window <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([i + 1 - window, i + 1])
    return [(a, b) for a, b in out]


def shard_index(window: int):
    """The index of one shard: an automaton of its contents, through which each of them streams."""

    def index(contents: list[bytes], n: np.ndarray, low: np.ndarray) -> list[list[tuple[int, int]]]:
        automaton, texts = SuffixAutomaton(), [c.split(b" ") for c in contents]
        for words, doc in zip(texts, low.tolist()):
            automaton.add(words, doc)
        automaton.close()
        return [matched_spans(automaton, words, window, doc) for words, doc in zip(texts, low.tolist())]

    return index


def repeated_in_corpus(ws: Workspace, rows: DataFrame, window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """(row, spans of words) of what an earlier document has; ``rows``: (row, doc_id, text)."""
    return repeated_spans(ws, rows, Alphabet(window, gram, True), shard_index(window), True, SHARD_BYTES, **options)


KEPT = "doc_id long, text string, n_words long, n_removed long, spans array<struct<a:bigint,b:bigint>>, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_batches(batches, "text", 4 << 20):
        kept, total, gone, spans, sums = [], [], [], [], []
        for text, covered in zip(binary_list(batch.column("text")), batch.column("spans").to_pylist()):
            words = text.split()
            total.append(len(words))
            found = cover(covered, len(words))
            spans.append([{"a": a, "b": b} for a, b in found])
            gone.append(sum(b - a for a, b in found))
            for a, b in reversed(found):
                del words[a:b]
            kept.append(b" ".join(words))
            sums.append(hashlib.sha256(kept[-1]).hexdigest())
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(sums)], ["doc_id", "text", "n_words", "n_removed", "spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """(doc_id, text without repeated passages, n_words, n_removed, spans, kept_sha256) for every row of ``docs``."""
    ws = Workspace(docs.sparkSession, "substring")
    rows = numbered(ws, docs)
    spans = repeated_in_corpus(ws, rows, window, gram, **options)
    return gathered(rows.join(spans, "row", "left")).select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "text", "spans").mapInArrow(_remove, KEPT)


def _known(automata, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "text", 4 << 20):
            spans = []
            for text in binary_list(batch.column("text")):
                words = text.split()
                spans.append([{"a": a, "b": b} for automaton in automata.value for a, b in matched_spans(automaton, words, window, LAST + 1)])
            yield from _remove([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["doc_id", "text", "spans"])])

    return scan


def remove_known(docs: DataFrame, references: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same columns, without passages of ``references`` (text), whose automata are broadcast.

    More references than BROADCAST_BYTES are refused: they belong in ``remove_repeats`` beside the documents.
    """
    size = references.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of references; at most {BROADCAST_BYTES} are broadcast")
    automata, held = [SuffixAutomaton()], 0
    for (text,) in references.where("text is not null").select("text").collect():
        if held > SHARD_BYTES:
            automata.append(SuffixAutomaton())
            held = 0
        automata[-1].add(text.encode().split(), 0)
        held += len(text)
    shared = docs.sparkSession.sparkContext.broadcast([a.close() for a in automata])
    return docs.select("doc_id", "text").mapInArrow(_known(shared, window), KEPT)
