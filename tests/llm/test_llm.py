"""Each training-text operator against brute force, on texts with every odd case, and on the smallest tables."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import bpe, common, exact_dedup, mixing, quality, queries, sharding, simhash, substring_dedup, suffix_dedup, token_files, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, n long, spans string, size int, kept string, draws int"
SPACE = re.compile("[\x20\x09-\x0d]+")


def texts() -> list[tuple[int, str | None]]:
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    words = lambda n: [word() for _ in range(n)]
    shared = words(70)
    out: list[str | None] = [None, "", " \t", "a", "A  b\nc", "a b\x0bc", "a b c", "ünïcode ÉÀ 日本   x", "it's <|endoftext|> 123 ½", "x" * 3000, "ab " * 400]
    for i in range(25):
        text = words(rnd.randint(5, 160))
        if i % 3 == 0:
            text[rnd.randint(0, len(text)):0] = shared[rnd.randint(0, 9):rnd.randint(55, 70)]
        out.append(rnd.choice([" ", "\n", "  "]).join(text))
    out += [out[14], out[15], out[14].replace(" ", "\t"), out[16][:-1] + "z"]
    big = words(6000)
    out += [" ".join(big), " ".join(big[:3000] + ["new"] + big[3001:])]
    return list(enumerate(out))


def frame(spark, rows, parts: int = 3):
    full = [(i, t, ("en", "fr", None)[(i or 0) % 3], ("s1", "s2", None, "s1", "s1")[(i or 0) % 5], 1, 5, "k", 6, "s", 7, "x", 8) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 exact dedup


def exact_wanted(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("width,digest", [(32, exact_dedup.sha256_digest), (2, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 5), 4, "0")))])
def test_exact(spark, docs, width, digest):
    """The second digest makes most texts collide: verification must part them."""
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.find_copies(docs, digest, width, memtable_rows=4).collect()}
    assert found == exact_wanted(texts())


def test_exact_unlike_texts_of_one_id(spark):
    """One id, several texts, one digest: each text is a group of its own."""
    rows = [(1, "a"), (1, "b"), (1, "b  "), (2, "b "), (1, "a"), (None, "b"), (None, "c"), (3, "c")]
    digest = lambda t: F.unhex(F.lpad(F.hex(F.length(t) * 0), 4, "0"))
    found = Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.find_copies(frame(spark, rows), lambda t: digest(F.trim(t)), 2, 2).collect())
    assert found == Counter([(1, 1, 2), (1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (None, 1, 2), (None, 3, 2), (3, 3, 2)])


@pytest.mark.parametrize("regions,shards", [(2, 13), (4, 16), (256, 5)])
def test_exact_compaction_in_steps(spark, regions, shards):
    rnd = random.Random(3)
    rows = [(i, bytes(rnd.choice(b"abcd") for _ in range(4))) for i in range(500)]
    digests = spark.createDataFrame(rows, "doc_id long, digest binary").repartition(6)
    index = exact_dedup.build_index(common.Workspace(spark, "t"), digests, 4, 16, regions, shards).collect()
    wanted = defaultdict(list)
    for i, d in rows:
        wanted[d].append(i)
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in index} == {d: (min(x), len(x)) for d, x in wanted.items()} and len(index) == len(wanted)
    assert {r.shard for r in index} <= set(range(shards)) and all(r.shard == int(exact_dedup.shard_of(np.array([bytes(r.digest)], "S4"), shards)[0]) for r in index)


def test_exact_filter_and_merge():
    rnd = np.random.default_rng(1)
    runs = []
    for _ in range(5):
        d = np.array([bytes(rnd.integers(0, 4, 32, np.uint8) | 1) if rnd.random() < 0.5 else bytes(rnd.integers(1, 255, 32, np.uint8)) for _ in range(50)] + [b"\1" * 32], "S32")
        runs.append(exact_dedup.Run(d, rnd.integers(0, 1000, len(d)), np.ones(len(d), np.int64)))
        assert exact_dedup.may_hold(runs[-1].bits, d).all()
    merged = exact_dedup.merge(runs)
    wanted: dict[bytes, list[int]] = {}
    for r in runs:
        for d, i, n in zip(r.digest.tolist(), r.ids.tolist(), r.n.tolist()):
            w = wanted.setdefault(d, [i, 0])
            w[0], w[1] = min(w[0], i), w[1] + n
    assert merged.digest.tolist() == sorted(wanted) and [[i, n] for i, n in zip(merged.ids.tolist(), merged.n.tolist())] == [wanted[d] for d in sorted(wanted)]


def test_exact_repeats_and_nulls(spark):
    rows = [(3, "a b"), (3, "a b"), (None, "a  b"), (5, "c"), (None, "d"), (7, None), (8, "")]
    found = exact_dedup.find_copies(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in found) == [(-1, -1, 1), (-1, 3, 4 - 1), (3, 3, 3), (3, 3, 3), (5, 5, 1), (7, 7, 2), (8, 7, 2)]
    left = exact_dedup.deduplicate(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns and sorted((r.doc_id or -1) for r in left.collect()) == [-1, 3, 5, 7]


def test_exact_repeats_leave_other_texts(spark):
    rows = [(3, "a b"), (3, "a b"), (3, "c"), (None, "d"), (None, "e"), (None, "e"), (None, "a  b"), (5, None), (5, "f")]
    left = exact_dedup.deduplicate(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id or -1), r.text or "") for r in left.collect()) == [(-1, "d"), (-1, "e"), (3, "a b"), (3, "c"), (5, ""), (5, "f")]


# 2 quality


def brute_base(t: str | None):
    words = re.findall("[^\x20\x09-\x0d]+", t or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if SPACE.sub("", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_quality_base(docs):
    extra = [(900, "a b c d e f\na b c d e f\n#$ |x\n \na b c d e f"), (901, "one two three four five six seven eight nine ten")]
    both = docs.unionByName(frame(docs.sparkSession, extra))
    found = table(quality.judge(both))
    for i, t in texts() + extra:
        r, w = found[i], brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == w
        assert r.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0]) and not (r.base_failed and r.kept)


def test_quality_distance():
    p = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    d = quality.js_distance(p, np.array([0.5, 0.5, 0.0]))
    assert d[0] == 0 and d[1] == pytest.approx(1.0)


def test_quality_common_words_are_exact(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    known = quality.references(docs.repartition(5))
    counts = defaultdict(Counter)
    for r in docs.collect():
        counts[r.lang].update(r.text.encode().lower().split())
    for lang, own in counts.items():
        total = own.total()
        wanted = sorted(((n, w) for w, n in own.items() if n >= quality.COMMON_SHARE * total), key=lambda x: (-x[0], x[1]))[: quality.COMMON_WORDS]
        assert list(known[lang].place) == [w for _, w in wanted]
        assert known[lang].words[:-1] == pytest.approx([n / total for n, _ in wanted])


@pytest.mark.parametrize("most", [40, 10**6])
def test_quality_candidates_are_few_and_complete(spark, most):
    rnd = random.Random(9)
    words = [f"w{min(int(rnd.expovariate(0.02)), 400)}" for _ in range(20_000)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(1000)]
    docs = frame(spark, rows, 7)
    found = defaultdict(set)
    for r in quality.may_be_common(docs.select("lang", "text"), 0.01, most).collect():
        found[r.lang].add(bytes(r.word).decode())
    for lang in ("en", "fr", None):
        own = Counter(w for r in docs.collect() if r.lang == lang for w in r.text.split())
        assert {w for w, n in own.items() if n >= 0.01 * own.total()} <= found[lang] <= {w for w, n in own.items() if n >= 0.005 * own.total()}


def test_quality_parts_good_from_poor(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judge(common.documents(spark, sf)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed and n_words >= 60").collect()
    good, poor = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(poor) < 0.35


def test_quality_empties_other_caches():
    text = pa.record_batch({"lang": ["en"], "text": ["some words"]})
    for scan in (quality._candidates(0.01), quality._count({"en": {b"some"}})):
        bpe.codec(queries.tokenizer_path()).words([b"some words"])
        assert bpe.codec.cache_info().currsize == 1
        assert sum(b.num_rows for b in scan(iter([text]))) > 0
        assert bpe.codec.cache_info().currsize == 0


def test_quality_memory_of_a_large_batch():
    import tracemalloc

    batch = pa.record_batch({"lang": ["en"] * 400, "text": ["ten chars " * 1000] * 400})  # 4 MB, what Spark hands over at once
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in quality._count({"en": {b"ten"}})(iter([batch]))) == 2 + quality.CLASSES
        assert tracemalloc.get_traced_memory()[1] < 50 << 20
    finally:
        tracemalloc.stop()


def test_quality_keep(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}


# 3 and 4 substring dedup


def brute_words(rows, window):
    first, out = {}, {}
    cut = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in rows}
    for i in sorted(cut):
        for s in range(len(cut[i]) - window + 1):
            first.setdefault(tuple(cut[i][s : s + window]), i)
    for i, w in cut.items():
        gone = {s + k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for k in range(window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("group", [1, 256])
@pytest.mark.parametrize("window,gram", [(50, 19), (6, 3)])
def test_substring(docs, window, gram, group):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, window, gram, group=group).collect()}
    assert found == brute_words(texts(), window)


def brute_bytes(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    n = Counter(b[s : s + length] for b in data.values() for s in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        covered = (np.cumsum(gone) > 0)[:-1]
        spans = int((np.diff(np.r_[False, covered].astype(int)) == 1).sum())
        out[i] = (len(b), int(covered.sum()), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("group", [1, 256])
@pytest.mark.parametrize("length,gram", [(400, 145), (40, 12)])
def test_suffix(docs, length, gram, group):
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length, gram, group=group).collect()}
    assert found == brute_bytes(texts(), length)


def test_passages_with_repeated_ids(spark):
    rows = [(1, "w " + " ".join(f"p{i}" for i in range(60))), (1, " ".join(f"p{i}" for i in range(60)) + " v"), (None, " ".join(f"p{i}" for i in range(60))), (9, None)]
    words = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert words == [(-1, 60), (1, 0), (1, 0), (9, 0)]
    long = [(1, "q" * 500), (1, "q" * 500), (2, "r" * 399), (3, "r" * 399)]
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, long)).collect()) == [(1, 500), (1, 500), (2, 0), (3, 0)]


def test_automaton_statistics():
    rnd = random.Random(2)
    for _ in range(30):
        refs = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 25))] for _ in range(4)]
        a = substring_dedup.SuffixAutomaton()
        for d, r in enumerate(refs):
            a.add(r, d)
        a.close()
        query = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        for i, (n, low) in enumerate(a.statistics(query, 6)):
            def holds(k, end=i + 1):
                return [d for d, r in enumerate(refs) if any(r[s : s + k] == query[end - k : end] for s in range(len(r) - k + 1))]
            longest = max(k for k in range(0, min(6, i + 1) + 1) if k == 0 or holds(k))
            assert n == longest and (not n or low == min(holds(n)))


def test_remove_known(spark):
    passage = [f"k{i}" for i in range(55)]
    rows = [(1, "x " + " ".join(passage) + " y"), (2, " ".join(passage[:49])), (3, None)]
    refs = spark.createDataFrame([("a " + " ".join(passage),), (None,)], "text string")
    found = table(substring_dedup.remove_known(frame(spark, rows), refs))
    assert (found[1].text, found[1].n_removed, found[2].n_removed, found[3].n_words) == ("x y", 55, 0, 0)


def test_run_length_statistics():
    rnd = random.Random(4)
    for _ in range(30):
        given = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 5))]
        bwt = suffix_dedup.RunLengthBWT(given)
        found = bwt.statistics()
        assert bwt.lengths.sum() == bwt.size
        for t, (text, at) in enumerate(zip(given, bwt.starts.tolist())):
            for s in range(len(text)):
                best = 0
                for u, other in enumerate(given):
                    for v in range(len(other)):
                        if (t, s) != (u, v):
                            k = 0
                            while s + k < len(text) and v + k < len(other) and text[s + k] == other[v + k]:
                                k += 1
                            best = max(best, k)
                assert found[at + s] == best


def test_parts_cover_each_window_once():
    rnd = random.Random(6)
    data = [bytes(rnd.choice(b"ab c") for _ in range(rnd.choice([0, 3, 30, 200]))) for _ in range(9)]
    raw, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    doc, lo, hi, p, key = windows.cut_parts(raw, at, windows.Alphabet(20, 7, False))
    seen, anchor = Counter(), {}
    for d, a, b, c, k in zip(*(x.tolist() for x in (doc, lo, hi, p, key))):
        for s in range(a, b + 1):
            seen[d, s] += 1
            assert s <= c <= s + 13
            assert anchor.setdefault(data[d][s : s + 20], (c - s, k)) == (c - s, k)
    assert seen == {(d, s): 1 for d, t in enumerate(data) for s in range(len(t) - 19)}


# 5 sharding


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        f = sharding.Feistel(n)
        p = f(np.arange(n))
        assert sorted(p.tolist()) == list(range(n)) and f(p, inverse=True).tolist() == list(range(n))


def test_sharding(docs):
    found = sharding.shard_rows(docs, 16).collect()
    rows = dict(texts())
    by_shard = defaultdict(list)
    for r in found:
        data = (rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.row) == (len(data) + 1, zlib.crc32(data), r.doc_id)
        assert sharding.locate(r.row, len(rows)) == (r.shard, r.slot) and sharding.row_at(r.shard, r.slot, len(rows)) == r.row
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    counts = [len(by_shard[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(docs.repartition(7)).collect()} == {(r.doc_id, r.shard, r.slot) for r in found}


def test_sharding_repeats(spark, tmp_path):
    found = sharding.shard_rows(frame(spark, [(1, "a")] * 20 + [(None, None)] * 20), 4).collect()
    assert sorted((r.shard, r.slot) for r in found) == [(s, k) for s in range(4) for k in range(10)]
    rows = texts() + [(3, "again"), (3, "again"), (None, None), (None, "n"), (7, None)]
    given = frame(spark, rows).withColumns({"shard": F.lit("mine"), "slot": F.col("n")})
    sharding.write_shards(given, f"file://{tmp_path}/shards", 4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in back.collect()) == Counter((i, t, "mine", 6) for i, t in rows)
    wanted = Counter((r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(given, 4).collect())
    assert Counter((r.doc_id, r._shard, r._slot) for r in back.collect()) == wanted


# 6 and 7 token files, 9 BPE


@pytest.mark.parametrize("delta", [False, True])
def test_token_parquet(spark, docs, tokenizer, tmp_path, delta):
    path = f"file://{tmp_path}/ids"
    token_files.write_parquet(docs, path, queries.tokenizer_path(), delta=delta)
    found, start = table(token_files.checksums(spark, path)), 0
    for i, t in texts():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        r = found[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert {r.doc_id for r in token_files.read_tokens(spark, path, 3, 5).collect()} == {3, 4, 5}
    assert {(r.doc_id, r.start) for r in token_files.read_metadata(spark, path).collect()} == {(i, r.start) for i, r in found.items()}
    import glob

    import pyarrow.parquet as pq

    order = [i for f in sorted(glob.glob(f"{tmp_path}/ids/*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert order == sorted(order)


@pytest.mark.parametrize("block", [2, 64, 4 << 20])
def test_separator_scan(spark, docs, tokenizer, block):
    ws = common.Workspace(spark, "t")
    few = docs.where("doc_id < 9 or doc_id > 30 and doc_id < 38") if block == 2 else docs
    folder, manifest = token_files.write_flat(ws, few, queries.tokenizer_path(), queries.SEPARATOR)
    counts = token_files.scan_separators(ws, folder, manifest.select("file").distinct(), queries.SEPARATOR, block_bytes=block)
    found = {r.doc_id: r.n_tokens for r in manifest.join(counts, ["file", "doc_no"]).collect()}
    ids = {r.doc_id for r in few.collect()}
    assert found == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts() if i in ids}


def test_separator_scan_of_plain_files(spark):
    ws = common.Workspace(spark, "t")
    files = {"a.bin": [5, 6, 2, 7, 2, 8], "b.bin": [], "c.bin": [2, 2], "d.bin": [9]}
    store, path = token_files._files(f"{ws.path}/flat")
    store.create_dir(path, recursive=True)
    for name, ids in files.items():
        with store.open_output_stream(f"{path}/{name}") as f:
            f.write(struct.pack(f"<{len(ids)}H", *ids))
    for block in (2, 4, 64):
        own = common.Workspace(spark, "u")
        found = sorted(tuple(r) for r in token_files.scan_separators(own, f"{ws.path}/flat", spark.createDataFrame([(n,) for n in files], "file string"), 2, block_bytes=block).collect())
        assert found == [("a.bin", 0, 0, 3, True), ("a.bin", 1, 3, 2, True), ("a.bin", 2, 5, 1, False), ("c.bin", 0, 0, 1, True), ("c.bin", 1, 1, 1, True), ("d.bin", 0, 0, 1, False)]


def odd_texts() -> list[str]:
    rnd = random.Random(1)
    fixed = ["", "'S don't WE'LL İ ﬀ ΑΣ ǅ", "<|startoftext|>A<|ENDOFTEXT|>", "a\x1cb \x85 ​</w> a</w>b \x00\x7f", "× ÷ café naïve ½ Ⅷ 12", "日本語 \U0001f600\U0001f600 é  　", "y" * 3000]
    return fixed + ["".join(rnd.choice("ab'sStre.,!<|endoftext|>/w éÀßσς×\n\t1İ́") for _ in range(50)) for _ in range(200)]


def test_bpe_is_the_library(tokenizer):
    own = bpe.BPE(queries.tokenizer_path())
    words = token_files.WordEncoder(queries.tokenizer_path())
    for text in odd_texts() + [t or "" for _, t in texts()]:
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        found = [own.cache[p] for p in own.words([text.encode()])[0]]
        assert b" ".join(f[1] for f in found if f[1]).decode() == " ".join(map(str, wanted))
        assert b" ".join(f[2] for f in found if f[2]).decode() == tokenizer.decode(wanted, skip_special_tokens=False)
        assert [x.tolist() for x in words.encode([text.encode()], 2)] == [[*wanted, 2], [len(wanted) + 1]]


def test_bpe_parts():
    own = bpe.BPE(queries.tokenizer_path())
    marked = ["the" + bpe.END, "tionhe" + bpe.END, "qqzzqq" + bpe.END, "a" + bpe.END]
    found, merged = own.encode_marked(marked)
    assert found == [own.merge(w) for w in marked] and 0 <= merged <= 4


def test_bpe_frame(docs, tokenizer):
    found = table(bpe.encode_decode(docs, queries.tokenizer_path(), ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), ("doc_id", "source")))
    for i, t in texts():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        r = found[i]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, text)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# 8 mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 1000], [1, 1]) == pytest.approx([30, 980])
    assert mixing.targets([0, 5], [1, 2]) == pytest.approx([0, 5]) and mixing.targets([], []) == []


def test_split_quotas():
    quotas = np.array([100, 7, 0, 33])
    found = mixing.split_quotas(quotas, 6)
    assert (found.sum(axis=0) == quotas).all() and found.sum(axis=1).max() - found.sum(axis=1).min() <= 1
    assert (found == mixing.split_quotas(quotas, 6)).all()


def test_split_quotas_is_hypergeometric():
    """Over many seeds the first shard's mean share is the quotas' share, with the sampling variance of draws without return."""
    quotas, n = np.array([60, 30, 10]), 4
    found = np.array([mixing.split_quotas(quotas, n, seed)[0] for seed in range(3000)])
    assert found.mean(axis=0) == pytest.approx(quotas / n, abs=0.15)
    p = quotas / 100
    assert found.var(axis=0) == pytest.approx(25 * p * (1 - p) * 75 / 99, rel=0.12)


def brute_mix(rows: list[tuple[int | None, str | None, str | None]], block_words: int, weights=(1, 2, 3), repeats: int = 3):
    """(source, quota, blocks) of each source and, of each distinct (doc_id, text, source), the (pass, block) of its draws."""
    xx = xxhash.xxh64_intdigest
    units: dict = {}
    for i, text, source in rows:
        tie = 42 if text is None else xx(text.encode(), 42)
        key = xx(struct.pack("<i", 42), 42)
        key = key if i is None else xx(struct.pack("<q", i), key)
        unit = units.setdefault((i, text, source), [xx(struct.pack("<Q", tie), key), 0])
        unit[1] += len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    order = sorted({u[2] for u in units}, key=lambda s: (s is None, s or ""))
    sizes = [sum(w for u, (_, w) in units.items() if u[2] == s) for s in order]
    draws, quotas = {}, []
    for s, size, goal in zip(order, sizes, mixing.targets(sizes, [weights[k % 3] for k in range(len(order))], repeats)):
        own = sorted((key, u, w) for u, (key, w) in units.items() if u[2] == s)
        passes = min(repeats, int(goal // size)) if size else 0
        rest, before, extra = goal - passes * size, 0, set()
        for _, u, w in own:
            before += w
            if rest > 0 and before <= rest:
                extra.add(u)
        gap = max(0.0, rest - sum(w for _, u, w in own if u in extra))
        ahead, more = 0, set()
        for _, u, w in own:
            if u not in extra and 0 < w <= gap:
                ahead += w
                if ahead <= gap:
                    more.add(u)
        extra |= more
        gap = max(0.0, rest - sum(w for _, u, w in own if u in extra))
        blocks = max(1, size // block_words)
        block = {u: (key >> 32) * blocks >> 32 for key, u, _ in own}
        used, tops = max((block[u] + 1 for u in extra), default=0), set()
        for step in range(6):
            fits = [(abs(gap - w), key, u, w) for key, u, w in own if u not in extra | tops and w and (w <= gap if step < 5 else abs(gap - w) < gap)]
            if fits:
                _, _, u, w = min(fits, key=lambda x: x[:2])
                tops.add(u)
                gap = max(0.0, gap - w)
        used = max(used, int(bool(tops)))
        quotas.append((s, passes * blocks + used, blocks))
        for _, u, _ in own:
            last = [(passes, min(block[u], used - 1))] if u in extra | tops else []
            draws[u] = [(k, block[u]) for k in range(passes)] + last
    return quotas, draws


def mix_rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.mark.parametrize("repeated", [False, True])
def test_mixing(spark, docs, repeated):
    if repeated:
        docs = docs.unionByName(docs.where("doc_id > 20").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s1").otherwise(F.col("source")))).unionByName(docs.where("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    rows, given = mixing.plan(docs, block_words=50, shards=4).collect(), mix_rows(docs)
    quotas, wanted = brute_mix(given, 50)
    known = Counter((i, s, len(re.findall("[^\x20\x09-\x0d]+", t or "")), tuple(wanted[i, t, s])) for i, t, s in given)
    assert Counter((r.doc_id, r.source, r["size"], tuple((d["pass"], d.block) for d in r.draws)) for r in rows) == known
    ends = np.cumsum(mixing.split_quotas(np.array([q for _, q, _ in quotas]), 4), axis=0)
    blocks = {s: (k, b) for k, (s, _, b) in enumerate(quotas)}
    for r in rows:  # each draw of a block is one shard's, by the tree
        k, b = blocks[r.source]
        assert [d.shard for d in r.draws] == [int((ends[:, k] <= d["pass"] * b + d.block).sum()) for d in r.draws] and len(r.draws) <= 3
    order = [s for s, _, _ in quotas]
    sizes = [sum(r["size"] for r in rows if r.source == s) for s in order]
    goal = mixing.targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(order))])
    for s, size, t in zip(order, sizes, goal):
        own = [r for r in rows if r.source == s]
        assert {(r.source_size, r.target) for r in own} == {(size, t)}
        assert repeated or abs(sum(r["size"] * len(r.draws) for r in own) - t) <= max(r["size"] for r in own) / 2
    again = Counter((r.doc_id, tuple((d.shard, d.place) for d in r.draws)) for r in mixing.plan(docs.repartition(5), block_words=50, shards=4).collect())
    assert again == Counter((r.doc_id, tuple((d.shard, d.place) for d in r.draws)) for r in rows)
    mixed = mixing.mix(docs, block_words=50, shards=4)
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == sum((Counter({(r.doc_id, r.source): len(r.draws)}) for r in rows if r.draws), Counter())
    assert set(docs.columns) <= set(mixed.columns)


def test_mix_is_written_shuffled(spark, docs, tmp_path):
    assert mixing.shuffled(docs, block_words=50, shards=4).columns == docs.columns
    mixing.write_mix(docs, f"file://{tmp_path}/mix", block_words=50, shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/mix")
    wanted = Counter((r.doc_id, r._mix_shard) for r in mixing.mix(docs, block_words=50, shards=4).collect())
    assert Counter((r.doc_id, r._mix_shard) for r in back.collect()) == wanted
    import glob

    import pyarrow.parquet as pq

    for f in glob.glob(f"{tmp_path}/mix/*/*.parquet"):
        places = [x % (1 << 64) >> 1 for x in pq.ParquetFile(f).read(columns=["_mix_place"])["_mix_place"].to_pylist()]
        assert places == sorted(places)


def test_shard_count():
    assert mixing.shard_count(0, 0) == 16 and mixing.shard_count(800_000_000, 3) == 100
    assert mixing.shard_count(10**14, 1000) == mixing.CELLS // 1000 and mixing.shard_count(10**14, 10**7) == 16


# 10 SimHash


def brute_print(t: str | None, shingle: int = 4) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    label = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for i in prints:
            low = min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= radius)
            moved |= low < label[i]
            label[i] = low
    return label


def test_simhash(docs):
    prints = {i: brute_print(t) for i, t in texts()}
    wanted = brute_components(prints, 4)
    found = simhash.near_groups(docs).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in found} == {i: (prints[i], wanted[i]) for i in prints}


@pytest.mark.parametrize("block_nodes,tree_nodes,keys_at_once", [(1024, 20_000, 64), (1, 20_000, 2), (0.01, 3, 64), (0.01, 3, 9), (1024, 3, 1)])
def test_links(spark, block_nodes, tree_nodes, keys_at_once):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(4)]
    values = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(30)})
    prints = dict(enumerate(values))
    ws = common.Workspace(spark, "t")
    nodes = ws.save(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()], "fp long, doc_id long"), "nodes")
    stars = ws.save(simhash.linked_nodes(ws, nodes, 4, block_nodes, tree_nodes, keys_at_once=keys_at_once), "stars")
    label = {r.node: r.component for r in common.connected_components(ws, stars).collect()}
    assert {i: label.get(i, i) for i in prints} == brute_components(prints, 4)


def test_bk_forest():
    rnd = np.random.default_rng(3)
    fp = np.unique(rnd.integers(0, 1 << 12, 300, np.uint64))
    tree = np.sort(rnd.integers(0, 4, len(fp)))
    forest = simhash.BKForest(fp, tree)
    roots = forest.roots[np.searchsorted(tree[forest.roots], tree)]
    found = {(int(q), int(v)) for qs, vs in forest.within(fp, roots, 2) for q, v in zip(qs, vs)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if tree[i] == tree[j] and int(fp[i] ^ fp[j]).bit_count() <= 2}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    ws = common.Workspace(spark, "t")
    found = {r.node: r.component for r in common.connected_components(ws, spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: label[x] for x in touched}


def brute_pair(t: str | None) -> tuple[int, int]:
    """Both fingerprints of a text, of the distinct hashes of its two-word and its five-word shingles."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, out, top = re.findall("[^\x20\x09-\x0d]+", low), [], (1 << 64) - 1
    for shingle in (2, 5):
        grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        out.append({xxhash.xxh64_intdigest(g.encode(), 42) for g in grams})

    def mixed(h: int, lane: int) -> int:
        if lane == 0:
            return h
        h = (h + lane * 0x9E3779B97F4A7C15) & top
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & top
        h = (h ^ h >> 27) * 0x94D049BB133111EB & top
        return h ^ h >> 31

    fold = lambda hs: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))
    return fold(out[0]), sum(fold([mixed(h, lane) for h in out[1]]) << 64 * lane for lane in range(4))


def brute_similar(texts_: list[str | None], bits: int) -> list[int]:
    """For each text the first one of its group."""
    prints = [brute_pair(t) for t in texts_]
    label, moved = list(range(len(texts_))), True
    near = [[j for j, b in enumerate(prints) if (a[0] ^ b[0]).bit_count() <= 8 and (a[1] ^ b[1]).bit_count() <= bits] for a in prints]
    while moved:
        moved = False
        for i, others in enumerate(near):
            low = min(label[j] for j in others)
            moved |= low < label[i]
            label[i] = low
    return label


def similar_rows(n: int, copies: int) -> list[tuple[int | None, str | None]]:
    """Texts, copies of them with a few words changed or a part left out, and odd cases."""
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6)))
    out: list[tuple[int | None, str | None]] = [(None, None), (70_000, ""), (70_001, " \n"), (70_002, "a b"), (70_003, "A  b"), (None, "x " * 3000)]
    for k in range(n):
        base = [word() for _ in range(rnd.randint(60, 300))]
        out.append((len(out), " ".join(base)))
        for _ in range(copies):
            other = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 60)):
                other[rnd.randrange(len(other))] = word()
            if rnd.random() < 0.2:
                del other[: rnd.randint(1, len(other) // 3)]
            out.append((rnd.choice([len(out), len(out), 3, None]), " ".join(other)))
    return out + out[8:12]


@pytest.mark.parametrize("block_nodes,tree_nodes", [(64, 20_000), (1, 4), (1024, 5)])
def test_similar_groups(spark, block_nodes, tree_nodes):
    rows = similar_rows(6, 12)
    found = simhash.similar_groups(frame(spark, rows), block_nodes=block_nodes, tree_nodes=tree_nodes).collect()
    group = brute_similar([t for _, t in rows], simhash.wide_radius(0.8))
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r.digest, r.component_id) for r in found) == Counter(
        (i, None if t is None else hashlib.sha256(t.encode()).digest(), least[g]) for (i, t), g in zip(rows, group))
    assert len({r.component for r in found}) == len(set(group)) < len(rows) / 3
    kept = simhash.keep_similar(frame(spark, rows), block_nodes=block_nodes, tree_nodes=tree_nodes).collect()
    assert len(kept) == len(set(group)) and Counter(r.doc_id for r in kept) == Counter(least.values())


def test_similar_texts_are_found():
    """Of pairs with a similarity of 0.8 or more nearly all are linked, of pairs under 0.6 hardly any."""
    rnd, hits = random.Random(31), defaultdict(list)
    for _ in range(400):
        base = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(rnd.randint(80, 400))]
        other = [w if rnd.random() > 0.04 * (k := rnd.random()) * k else "new" + w for w in base]
        a, b = (set(zip(*(t[i:] for i in range(5)))) for t in (base, other))
        same = len(a & b) / len(a | b)
        x, y = brute_pair(" ".join(base)), brute_pair(" ".join(other))
        hits[same >= 0.8, same < 0.6].append((x[0] ^ y[0]).bit_count() <= 8 and (x[1] ^ y[1]).bit_count() <= simhash.wide_radius(0.8))
    assert len(hits[True, False]) > 100 and np.mean(hits[True, False]) > 0.9
    assert np.mean(hits[False, True] or [0]) < 0.05


def test_dense_groups_are_not_visited_in_full(monkeypatch):
    """3000 nodes within the radius of each other: far fewer visits than pairs, and one group."""
    rnd = np.random.default_rng(4)
    fp = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rnd.integers(0, 64, (3, 3000)).astype(np.uint64), axis=0))
    visits = []
    count = simhash.distance
    monkeypatch.setattr(simhash, "distance", lambda a, b: (visits.append(len(a)), count(a, b))[1])
    forest, label = simhash.BKForest(fp, np.zeros(len(fp), np.int64)), np.arange(len(fp))
    for q, v in forest.within(fp, np.zeros(len(fp), np.int64), 6, label, np.arange(len(fp))):
        simhash.join_sets(label, q, v)
    assert (label == 0).all() and sum(visits) < len(fp) ** 2 / 10


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in simhash.near_groups(docs).collect()})


def test_near_copies_with_null_and_repeated_ids(spark):
    rnd = random.Random(12)
    a, b, c, d, e, f = (" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(6))
    assert all((brute_print(x) ^ brute_print(y)).bit_count() > 20 for x, y in combinations((a, b, c, d, e, f), 2))
    near = {a: 3, b: 4}  # the same fingerprint as a null document's
    rows = [(None, a), (None, b), (None, c), (None, d), (None, d), (near[a], a.upper()), (near[b], b.upper()), (9, e), (9, f), (9, f)]
    found = simhash.near_groups(frame(spark, rows)).collect()
    prints = {t: brute_print(t) for _, t in rows}
    wanted = [(i, prints[t], near.get(t.lower(), 9 if t in (e, f) else None)) for i, t in rows]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == order(wanted)
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert order((r.doc_id, r.text) for r in kept.collect()) == order([(3, a.upper()), (4, b.upper()), (None, c), (None, d), (9, e), (9, f)])
    two = simhash.keep_one(frame(spark, [(None, a), (None, a + " "), (None, c), (7, None), (7, "")])).collect()
    assert len(two) == 3 and sorted((r.doc_id or -1) for r in two) == [-1, -1, 7]


# all


def odd_rows():
    return [(3, "a b"), (3, "a b"), (3, "A  b"), (None, None), (None, "x y"), (None, "x y"), (1, ""), (None, "é " * 300)]


def test_token_files_with_odd_ids(spark, tokenizer, tmp_path):
    """Null ids come first, equal ids are ordered by text; a flat file counts every row."""
    token_files.write_parquet(frame(spark, odd_rows()), f"file://{tmp_path}/ids", queries.tokenizer_path())
    found, start = token_files.checksums(spark, f"file://{tmp_path}/ids").orderBy("start").collect(), 0
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert len(found) == len(order)
    for r, (i, t) in zip(found, order):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    ws = common.Workspace(spark, "t")
    folder, manifest = token_files.write_flat(ws, frame(spark, odd_rows()), queries.tokenizer_path(), queries.SEPARATOR)
    counts = token_files.scan_separators(ws, folder, manifest.select("file").distinct(), queries.SEPARATOR)
    assert Counter((r.doc_id, r.n_tokens) for r in manifest.join(counts, ["file", "doc_no"]).collect()) == Counter((r.doc_id, r.n_tokens) for r in found)


def test_token_files_of_nothing(spark, docs, tmp_path):
    token_files.write_parquet(docs.limit(0), f"file://{tmp_path}/ids", queries.tokenizer_path())
    assert token_files.checksums(spark, f"file://{tmp_path}/ids").count() == token_files.read_metadata(spark, f"file://{tmp_path}/ids").count() == 0
    ws = common.Workspace(spark, "t")
    folder, manifest = token_files.write_flat(ws, docs.limit(0), queries.tokenizer_path(), queries.SEPARATOR)
    assert manifest.count() == token_files.scan_separators(ws, folder, manifest.select("file").distinct(), queries.SEPARATOR).count() == 0


def test_pipeline_with_odd_rows(spark, sf_dir):
    """Null and repeated ids, null, empty and equal texts, a very long one and columns with other operators' names, and no rows at all."""
    import corpus_pipeline as pipe

    rnd = random.Random(17)
    prose = lambda n: " ".join(rnd.choice("the of and to in a is that for it".split()) if rnd.random() < 0.6 else "".join(rnd.choices("abcdefgh", k=5)) for _ in range(n))
    texts_ = [prose(80) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts_)] + [(None, texts_[3]), (None, prose(90)), (None, prose(70)), (5, prose(60)), (5, texts_[5]), (6, None), (7, ""), (8, prose(30_000)), (9, texts_[9]), (9, texts_[9])]
    given = frame(spark, rows)
    for docs in (given, given.limit(0)):
        ws = common.Workspace(spark, "p")
        for i, (_, stage) in enumerate(pipe.STAGES):
            before, docs = docs, ws.save(stage(spark, docs, sf_dir), f"{i}")
            assert i == 4 or docs.columns == before.columns
            pairs = [(r.doc_id, r.text) for r in before.collect()]
            left = Counter((r.doc_id, r.text) for r in docs.collect()) if i < 4 else None
            if i == 0:
                assert left == Counter((r.doc_id, r.text) for r in quality.keep_good(before).collect())
            elif i == 1:
                groups = defaultdict(list)
                for d, t in pairs:
                    groups[SPACE.sub(" ", t or "")].append(d)
                assert Counter((d, SPACE.sub(" ", t or "")) for d, t in left.elements()) == Counter((min((d for d in g if d is not None), default=None), t) for t, g in groups.items())
            elif i == 2:
                distinct = list(dict.fromkeys(t for _, t in pairs))
                part = dict(zip(distinct, brute_similar(distinct, simhash.wide_radius(0.8))))
                least = {c: min((d for d, t in pairs if part[t] == c and d is not None), default=None) for c in set(part.values())}
                assert sum(left.values()) == len(left) == len(least) and all(least[part[t]] == d for d, t in left)
            elif i == 3:
                assert left == sum((Counter({(d, t): len(x)}) for (d, t, _), x in brute_mix(mix_rows(before), mixing.BLOCK_WORDS)[1].items() if x), Counter())
        assert docs.count() == before.count()


def test_lookup_with_heavy_keys(spark):
    ws = common.Workspace(spark, "t")
    rows = ws.save(spark.createDataFrame([(i % 3 if i % 2 else i, i) for i in range(3000)], "k long, v long"), "rows")
    index = ws.save(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "index")
    assert common.skew_safe_lookup(rows, index, ["k"], "n").count() == 3000


def test_ranked_sums(spark):
    rnd = random.Random(1)
    rows = [("a" if i % 3 else None, rnd.randrange(-(1 << 63), 1 << 63), rnd.randrange(9)) for i in range(300)]
    found = common.ranked_sums(spark.createDataFrame(rows, "g string, key long, size long"), ["g"], "key", "size", "before", 4).collect()
    for r in found:
        assert r.before == sum(s for g, k, s in rows if g == r.g and k % (1 << 64) < r.key % (1 << 64))


@pytest.mark.parametrize("run", [
    lambda d: exact_dedup.find_copies(d), lambda d: exact_dedup.deduplicate(d), lambda d: quality.judge(d), lambda d: quality.keep_good(d), lambda d: substring_dedup.remove_repeats(d), lambda d: suffix_dedup.remove_repeats(d),
    lambda d: sharding.shard_rows(d), lambda d: mixing.plan(d), lambda d: mixing.mix(d), lambda d: simhash.near_groups(d), lambda d: simhash.keep_one(d), lambda d: simhash.similar_groups(d), lambda d: simhash.keep_similar(d), lambda d: bpe.encode_decode(d, queries.tokenizer_path())])
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_queries_on_small_tables(spark, sf_dir):
    import oracle

    n = common.documents(spark, sf_dir).count()
    con = oracle.connect(sf_dir)
    for name, query in queries.QUERIES.items():
        found = query(spark, sf_dir).toPandas()
        assert len(found) == n and found["doc_id"].nunique() == n, name
        if name in queries.ORACLES:
            wanted = con.execute(queries.ORACLES[name]).df()
            assert oracle.normal(found) == oracle.normal(wanted), name


def test_pipeline(spark, sf_dir):
    """Each stage against what its operator decides on the stage's own input."""
    import corpus_pipeline as pipe

    ws = common.Workspace(spark, "p")
    docs, seen = common.documents(spark, sf_dir), []
    for i, (_, stage) in enumerate(pipe.STAGES):
        before, docs = docs, ws.save(stage(spark, docs, sf_dir), f"{i}")
        seen.append((before, docs))
        assert i == 4 or docs.columns == before.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    assert ids(seen[0][1]) == ids(quality.judge(seen[0][0]).where("kept"))
    assert set(ids(seen[1][1])) == {i for i, (k, _) in exact_wanted(pairs(seen[1][0])).items() if i == k}
    texts_ = sorted(pairs(seen[2][0]))
    wanted = brute_similar([t for _, t in texts_], simhash.wide_radius(0.8))
    assert set(ids(seen[2][1])) == {texts_[i][0] for i in wanted}
    assert ids(seen[3][1]) == {r.doc_id: len(r.draws) for r in mixing.plan(seen[3][0]).collect() if r.draws}
    assert ids(seen[4][1]) == ids(seen[3][1]) and {"doc_id", "ids", "n_tokens"} <= set(seen[4][1].columns)
