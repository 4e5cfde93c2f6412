"""Quality by distribution divergence from language references.

Each text's histogram of character classes and of its language's common words is compared with the language's own,
counted over all documents of that language, by the Jensen-Shannon distance (square root of the divergence in bits,
0 to 1).  A text is rejected if a distance passes its limit; each comparison has a minimum length, below which the
distance says more about chance than about the text.

*References.*  Common words are those with a share of at least COMMON_SHARE of a language's words.  Such a word has that share
in some scan task at least, so the union of the tasks' own lists holds them all (Savasere, Omiecinski and
Navathe, VLDB 1995) and one more scan counts exactly these, and the character classes.  The most frequent COMMON_WORDS stay.

*Base rules.*  Counts of words, word characters, symbols, repeated lines and words in repeated five-word windows.

Cases: null text has no words and fails the base rules; a null or empty language is a language of its own; texts in
a language without common words are compared by character classes alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, binary_list, flat_bytes, in_batches, let_go
from .windows import _BASE, _mix, word_bounds, word_codes

COMMON_SHARE, COMMON_WORDS = 0.004, 48
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: Limits of the two distances, and the least characters and words for which they are asked.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.42
MIN_CHARS, MIN_COMMON_WORDS = 200, 60
#: Character classes by first byte: lower and upper case, digit, space, line end, sentence mark, quote or bracket, other
#: ASCII mark, and other than ASCII; continuation bytes of UTF-8 count nothing.
CLASSES = 9
_CLASS = np.full(256, 8, np.uint8)
_CLASS[:128] = 7
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:!?", b"'\"()-")):
    _CLASS[list(_chars)] = _i
_CLASS[0x80:0xC0] = CLASSES
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``marks`` between offsets."""
    total = np.r_[0, np.cumsum(marks, dtype=np.int64)]
    return total[at[1:]] - total[at[:-1]]


def class_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    classes = _CLASS[raw]
    return np.stack([_sums(classes == k, at) for k in range(CLASSES)], axis=1)


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words in n-word windows that occur twice or more, the first occurrence too."""
    windows = list(zip(*(words[i:] for i in range(n))))
    counts = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    hits = np.array([i for i, w in enumerate(windows) if counts[w] > 1], np.int64)
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + n, -1)
    return int((np.cumsum(covered) > 0).sum())


def may_repeat(codes: np.ndarray, offsets: np.ndarray, n: int = 5) -> np.ndarray:
    """Texts that may have an n-word window twice, by hashes: never false for one that has."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(codes) < n:
        return out
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    with np.errstate(over="ignore"):
        key = _mix(doc[: len(codes) - n + 1].astype(np.uint64))
        for i in range(n):
            key = key * np.uint64(_BASE) + codes[i : len(codes) - n + 1 + i]
        key = _mix(key)
    inside = doc[: len(key)] == doc[n - 1 :]
    key, doc = key[inside], doc[: len(inside)][inside]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    out[doc[np.isin(key, twice)]] = True
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(raw: np.ndarray, at: np.ndarray, texts: list[bytes], cut: list[list[bytes]]) -> dict[str, np.ndarray]:
    starts, ends, offsets = word_bounds(raw, at)
    letter = (raw & 0xC0) != 0x80
    in_words = letter & ~((raw == 32) | ((raw - np.uint8(9)) <= 4))
    codes, _ = word_codes(raw, at)
    repeats = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(may_repeat(codes, offsets)).tolist():
        repeats[i] = repeated_words(cut[i])
    lines = ([x for x in t.split(b"\n") if x and not x.isspace()] for t in texts)
    return {
        "n_words": np.diff(offsets), "word_chars": _sums(in_words, at), "n_symbols": _sums(_SYMBOL[raw], at),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(texts)), "n_repeat_words": repeats,
    }


#: Bytes of text that are counted at once: sums over them take some twenty times that.
SLICE = 1 << 20

CANDIDATES = "lang string, word binary, n long, total long"
#: Distinct words that a task counts before it hands them on and starts anew.
COUNTED_WORDS = 500_000


def _candidates(share: float, most: int = COUNTED_WORDS):
    """For each stretch of a task's texts and each language: words with ``share`` of all its words or more, their counts and that of all (name: empty)."""

    def emit(counts: dict[str | None, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            total = own.total()
            words = [b"", *(w for w, n in own.items() if n >= share * total)]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array([total, *(own[w] for w in words[1:])], pa.int64()), pa.array([total] * len(words), pa.int64())], ["lang", "word", "n", "total"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts: dict[str | None, Counter] = defaultdict(Counter)
        for batch in in_batches(batches, "text", SLICE):
            for lang, text in zip(batch.column("lang").to_pylist(), binary_list(batch.column("text"))):
                counts[lang].update(text.lower().split())
            if sum(map(len, counts.values())) > most:
                yield from emit(counts)
                counts.clear()
        yield from emit(counts)

    return scan


def may_be_common(texts: DataFrame, share: float = COMMON_SHARE, most: int = COUNTED_WORDS) -> DataFrame:
    """(lang, word): 2 / share words of a language at most, and none is missing that has ``share`` of its words.

    Stretches name words from half the share on, so where they don't name a word it has less than half of the share.  A word
    stays if its named counts and half the share of all other stretches reach the share; then the named counts alone are half of it.
    """
    counted = texts.mapInArrow(_candidates(share / 2, most), CANDIDATES).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("total").alias("named"))
    named = Workspace(texts.sparkSession, "common").save(counted, "named", small=True)  # read twice
    total = named.where("word = X''").select(F.col("lang").alias("of"), F.col("n").alias("total"))  # one row for each language
    joined = named.where("word <> X''").join(F.broadcast(total), F.col("lang").eqNullSafe(F.col("of")))
    reach = F.col("n") + share / 2 * (F.col("total") - F.col("named"))
    return joined.where(reach >= share * F.col("total") * (1 - 1e-9)).select("lang", "word")


def _count(words_of: dict[str | None, set[bytes]]):
    """Exact counts for each language: named words, all words (name: empty) and character classes (name: a digit after a zero byte)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts: dict[str | None, Counter] = defaultdict(Counter)
        for batch in in_batches(batches, "text", SLICE):
            langs, texts = batch.column("lang").to_pylist(), binary_list(batch.column("text"))
            classes = class_counts(*flat_bytes(batch.column("text")))
            for lang, text, row in zip(langs, texts, classes.tolist()):
                words, own = text.lower().split(), counts[lang]
                named = words_of.get(lang, ())
                own.update([w for w in words if w in named])
                own[b""] += len(words)
                for k, n in enumerate(row):
                    own[b"\0%d" % k] += n
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])

    return scan


class Reference:
    """A language's shares of character classes and of its common words, the rest last."""

    def __init__(self, counts: dict[bytes, int]):
        total = counts.get(b"", 0)
        classes = np.array([counts.get(b"\0%d" % k, 0) for k in range(CLASSES)], float)
        words = sorted(((n, w) for w, n in counts.items() if w and not w.startswith(b"\0") and n >= COMMON_SHARE * total), key=lambda x: (-x[0], x[1]))[:COMMON_WORDS]
        self.classes = classes / max(classes.sum(), 1)
        self.place = {w: i for i, (_, w) in enumerate(words)}
        shares = np.array([n for n, _ in words], float) / max(total, 1)
        self.words = np.r_[shares, 1 - shares.sum()]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence, base 2, of each row of ``p`` from ``q``."""
    q = np.broadcast_to(q, p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(np.where(m > 0, x / m, 1)), 0).sum(axis=-1)
        return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def references(docs: DataFrame) -> dict[str | None, Reference]:
    """The reference of each language, from all documents; a few dozen numbers a language reach the driver."""
    ws = Workspace(docs.sparkSession, "quality")
    texts = docs.select("lang", "text")
    words: dict[str | None, set[bytes]] = defaultdict(set)
    for r in ws.save(may_be_common(texts), "candidates", small=True).collect():  # 500 for each language at most
        words[r.lang].add(bytes(r.word))
    counted = texts.mapInArrow(_count(dict(words)), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str | None, dict[bytes, int]] = defaultdict(dict)
    for r in ws.save(counted, "counts").collect():
        counts[r.lang][bytes(r.word)] = r.n
    return {lang: Reference(c) for lang, c in counts.items()}


SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def _score(known: dict[str | None, Reference], limits: tuple[float, float]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "text", SLICE):
            texts, langs = binary_list(batch.column("text")), batch.column("lang").to_pylist()
            raw, at = flat_bytes(batch.column("text"))
            cut = [t.split() for t in texts]
            base = base_counts(raw, at, texts, cut)
            classes = class_counts(raw, at)
            chars = classes.sum(axis=1)
            far, apart = np.zeros(len(texts)), np.zeros(len(texts))
            for lang in set(langs):
                rows = np.array([i for i, x in enumerate(langs) if x == lang])
                ref = known[lang]
                far[rows] = js_distance(classes[rows] / np.maximum(chars[rows], 1)[:, None], ref.classes)
                shares = np.zeros((len(rows), len(ref.words)))
                for k, i in enumerate(rows.tolist()):
                    for w, n in Counter(w for w in texts[i].lower().split() if w in ref.place).items():
                        shares[k, ref.place[w]] = n
                shares /= np.maximum(base["n_words"][rows], 1)[:, None]
                shares[:, -1] = 1 - shares[:, :-1].sum(axis=1)
                apart[rows] = js_distance(shares, ref.words) if len(ref.place) else 0
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED_PERCENT * base["n_words"])
            bad = (far > limits[0]) & (chars >= MIN_CHARS) | (apart > limits[1]) & (base["n_words"] >= MIN_COMMON_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(base[c].astype(np.int64)) for c in BASE], pa.array(np.round(far, 6)), pa.array(np.round(apart, 6)), pa.array(failed), pa.array(~failed & ~bad)],
                ["doc_id", *BASE, "class_distance", "word_distance", "base_failed", "kept"])

    return scan


def judge(docs: DataFrame, limits: tuple[float, float] = (MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE)) -> DataFrame:
    """Counts, distances and verdict for every row of ``docs`` (doc_id, text, lang)."""
    known = references(docs)
    return docs.select("doc_id", "lang", "text").mapInArrow(_score(known, limits), SCORES)


def _keep(known: dict[str | None, Reference], limits: tuple[float, float]):
    score = _score(known, limits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = pa.concat_arrays([b.column("kept") for b in score([batch])])
                yield batch.filter(kept)

    return scan


def keep_good(docs: DataFrame, limits: tuple[float, float] = (MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE)) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return docs.mapInArrow(_keep(references(docs), limits), docs.schema)
