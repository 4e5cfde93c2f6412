"""Byte-pair encoding and decoding by speculation and verification.

For words with marked ends (BPE with an end-of-word suffix) a segmentation is the encoding exactly if each adjacent
pair of its pieces is the encoding of the two pieces' text (Berglund and van der Merwe, 2023).  So:

* *Speculate.*  Each distinct word is cut greedily into the longest vocabulary pieces.
* *Verify.*  All adjacent pairs of all words are looked up at once in a sorted table of judged pairs; a pair
  that isn't there yet is judged once, by merging its own text, and stays there.
* *Merge.*  Only words with a pair that fails go through exact merging by rank.

Texts are cut into pre-tokens or, where they are not plain, at ASCII white space, which this kind of tokenizer drops
(see pieces.py); each distinct string is done once and a text's ids are theirs in a row.  Words of other than printable ASCII go through the tokenizer file's own
normaliser and pre-tokenizer; special tokens are found in the raw text, as the library does.

Cases: null text is empty and has no ids; words that are all (non-ASCII) white space have none either; very long words
are merged by a heap; the caches are bounded and start anew when full, which changes no result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHES, binary_list, in_batches, small_batches, trim
from .pieces import LETTERS, cut

#: Words whose results a worker keeps; judged pairs it keeps.
CACHED_WORDS, CACHED_PAIRS = 350_000, 1_000_000
#: Stands for the end-of-word suffix inside pieces; no byte is mapped to it.
END = "\ue000"
#: Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_ASCII = re.compile(rb"[!-~]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class BPE:
    """Speculative encoder of one tokenizer file (a BPE model with end-of-word suffix and no decoder)."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if not suffix or spec["decoder"] or model.get("dropout") or model.get("byte_fallback") or spec.get("post_processor"):
            raise ValueError("a plain BPE model with an end-of-word suffix and no decoder is needed")
        marked = lambda s: s[: -len(suffix)] + END if s.endswith(suffix) else s
        self.tokenizer = Tokenizer.from_file(path)
        self.texts = {i: t.encode() for t, i in model["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.numbers = {i: str(i).encode() for i in self.texts}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.ids = {marked(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.pieces = {i: t for t, i in self.ids.items()}
        self.reach: dict[str, int] = {}  # the longest piece that starts with two characters
        for t in self.ids:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[marked(a)], self.ids[marked(b)]] = rank, self.ids[marked(a + b)]
        self.known = np.zeros(0, np.int64)  # judged pairs, sorted; the lowest bit says whether they are compatible
        self.reset()

    def reset(self) -> None:
        self.cache: dict[bytes, tuple[bytes, bytes, bytes]] = {}

    # exact merging

    def merge(self, word: str) -> list[int]:
        """The encoding of one piece of text by rank, leftmost first; END must be attached to its last character."""
        atoms = [*word[:-2], word[-2:]] if word.endswith(END) else list(word)
        ids = [self.ids[c] for c in atoms]
        n = len(ids)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), self.merges
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    # speculation

    def propose(self, word: str) -> list[int]:
        """Greedy longest pieces of a marked word; a mark alone is never a piece."""
        ids, reach, out, i, n = self.ids, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach.get(word[i : i + 2], 1))
            while True:
                if (x := ids.get(word[i:j])) is not None and (j != n - 1 or word[j] != END):
                    break
                j -= 1
            out.append(x)
            i = j
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (first * 2**31 + second; second 2**31 - 1: none) is the encoding of its own text."""
        new = np.unique(pairs)
        at = np.searchsorted(self.known >> 1, new)
        new = new[(at >= len(self.known)) | ((self.known >> 1)[np.minimum(at, max(len(self.known) - 1, 0))] != new) if len(self.known) else np.ones(len(new), bool)]
        if len(new):
            if len(self.known) > CACHED_PAIRS:
                self.known = self.known[:0]
                return self.compatible(pairs)
            none, pieces = (1 << 31) - 1, self.pieces
            judged = [self.merge(pieces[a] + pieces[b] if b != none else pieces[a]) == ([a, b] if b != none else [a]) for a, b in zip((new >> 31).tolist(), (new & none).tolist())]
            self.known = np.sort(np.concatenate([self.known, new << 1 | np.array(judged, np.int64)]))
        return (self.known[np.searchsorted(self.known >> 1, pairs)] & 1).astype(bool)

    def encode_marked(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of marked words, and how many of them had to be merged."""
        if not words:
            return [], 0
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        after = np.r_[flat[1:], 0]
        after[ends - 1] = (1 << 31) - 1
        checked = np.ones(len(flat), bool)
        checked[(ends - 1)[sizes > 1]] = False  # the last piece of several has been judged in its pair
        good = np.ones(len(flat), bool)
        good[checked] = self.compatible((flat << 31 | after)[checked])
        bad = np.flatnonzero(np.add.reduceat(~good, ends - sizes))
        for i in bad.tolist():
            found[i] = self.merge(words[i])
        return found, len(bad)

    # words

    def _marked(self, word: bytes) -> list[str | int]:
        """A word as marked pre-tokens and special ids."""
        if word.isalpha():
            return [word.decode().lower() + END]
        if LETTERS.fullmatch(word):
            return [word.decode().lower().encode().decode("latin-1").translate(_BYTES) + END]
        if _ASCII.fullmatch(word) and b"<|" not in word:
            return [p + END for p in _PIECES.findall(word.decode().lower())]
        out: list[str | int] = []
        text, last, normal, pre = word.decode("utf-8", "replace"), 0, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for m in [*self.split.finditer(text), None]:
            if part := text[last : m.start() if m else len(text)]:
                out += [p + END for p, _ in pre.pre_tokenize_str(normal.normalize_str(part)) if p]
            if m:
                out.append(self.special[m[0]])
                last = m.end()
        return out

    def learn(self, words: Iterable[bytes]) -> None:
        """Put the words' ids (little-endian, decimal) and decoded text into the cache."""
        words = list(words)
        parts = [self._marked(w) for w in words]
        marked = list({p for c in parts for p in c if isinstance(p, str)})
        ids = dict(zip(marked, self.encode_marked(marked)[0]))
        texts, numbers = self.texts, self.numbers
        for word, c in zip(words, parts):
            own = ids[c[0]] if len(c) == 1 and isinstance(c[0], str) else [i for p in c for i in (ids[p] if isinstance(p, str) else (p,))]
            self.cache[word] = struct.pack(f"<{len(own)}I", *own), b" ".join([numbers[i] for i in own]), b" ".join([texts[i] for i in own])

    def words(self, texts: list[bytes]) -> list[list[bytes]]:
        """Each text's pre-tokens or words, all of them in the cache."""
        found = [cut(t) for t in texts]
        new = set().union(*found) - self.cache.keys()
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.reset()
            new = set().union(*found)
        self.learn(new)
        return found


@cache
def codec(path: str) -> BPE:
    """One encoder for each worker and file."""
    return BPE(path)


CACHES.append(codec.cache_clear)

COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _encode(path: str, columns: tuple[str, ...], kept: tuple[str, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        bpe = codec(path)
        for batch in in_batches(batches, "text", 2 << 20):
            out: dict[str, list] = {c: [] for c in columns}
            offsets, flat = [0], []
            for words in bpe.words(binary_list(batch.column("text"))):
                found = [bpe.cache[w] for w in words]
                packed = b"".join([f[0] for f in found])
                if "n_tokens" in out:
                    out["n_tokens"].append(len(packed) // 4)
                if "ids" in out:
                    flat.append(packed)
                    offsets.append(offsets[-1] + len(packed) // 4)
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(b" ".join([f[1] for f in found if f[1]])).hexdigest())
                if "decoded" in out or "decoded_sha256" in out:
                    decoded = b" ".join([f[2] for f in found if f[2]])
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if "ids" in out:
                out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
            if "decoded" in out:
                out["decoded"] = pa.array(out["decoded"], pa.binary()).cast(pa.string())
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64() if c == "n_tokens" else pa.string()) for c, x in out.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], [*kept, *columns])

    return scan


def encode_decode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``kept`` columns of ``docs`` and the asked ones of COLUMNS: ids of each whole text and what they decode to."""
    small_batches(docs.sparkSession)
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], *[f"{c} {COLUMNS[c]}" for c in columns]])
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(_encode(path, columns, kept), schema)
