"""Rules, edge cases and properties of the curation operators."""

from __future__ import annotations

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.functions import hashes, scalars, vectors
from gleaner.operators import calibration, duplicates, gates, matching, progress, review, selection
from gleaner.plans import catalogue, curation
from gleaner.plans.policy import PROFILES, Choice, Limits, Policy, named
from gleaner.sources import cache, files, journal, reports
from gleaner.sources.store import Tables


def test_policy_rules():
    assert named().limits.match == 0.72 and named(mode="normal").limits.match == 0.65 and named() == Policy()
    assert [named(strength=s).near_bits for s in ("strong", "normal", "exact")] == [8, 4, None]
    assert [named(strength=s, bits=3).near_bits for s in ("strong", "normal", "exact")] == [3, 3, None]
    assert all(abs(sum(w) - 1) < 1e-9 for w in PROFILES.values())
    assert Policy().text() == named().text() != named(count=3).text()
    for bad in ({"profile": "x"}, {"strength": "x"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            named(**bad)
    for bad in (lambda: Limits(match=1.5), lambda: Limits(match=-0.1), lambda: Choice(weights=(1.0,))):
        with pytest.raises(ValueError):
            bad()


def test_block_bounds():
    assert [w for _, w in hashes.block_bounds(8)] == [8, 7, 7, 7, 7, 7, 7, 7, 7]
    assert [w for _, w in hashes.block_bounds(4)] == [13, 13, 13, 13, 12]
    assert hashes.block_bounds(0) == [(0, 64)]
    with pytest.raises(ValueError):
        hashes.block_bounds(17)


@pytest.mark.parametrize("radius", [0, 2, 4, 8])
def test_close_hashes_brute_force(spark, radius):
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 10))) for b in base for _ in range(15)} | {0, (1 << 64) - 1}
    df = spark.createDataFrame([(f"{v:016x}",) for v in values], "hash string")
    found = {(r.a, r.b) for r in duplicates.close_hashes(df, radius).collect()}
    wanted = {(f"{a:016x}", f"{b:016x}") for a in values for b in values if a < b and (a ^ b).bit_count() <= radius}
    assert found == wanted


def _broadcasts(monkeypatch, run):
    """How many broadcast joins are planned in the result of ``run`` and in all tables that it writes."""
    plans, save = [], Tables.save
    plan = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(Tables, "save", lambda self, df, name: (plan(df), save(self, df, name))[1])
    plan(run())
    assert any("SortMergeJoin" in x for x in plans)
    return sum(x.count("BroadcastHashJoin") + x.count("BroadcastNestedLoopJoin") for x in plans)


def test_hamming_pairs_broadcast_nothing(spark, tmp_path, monkeypatch):
    spark.range(500).select(F.col("id").alias("doc_id"), F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("hash")).write.parquet(f"file://{tmp_path}/items")
    df = spark.read.parquet(f"file://{tmp_path}/items")  # 45 keys a hash come from a file of a few KB
    assert _broadcasts(monkeypatch, lambda: duplicates.close_hashes(df.select("hash"), 8)) == 0
    assert _broadcasts(monkeypatch, lambda: duplicates.hamming_pairs(df, "doc_id", 8)) == 0


@pytest.mark.parametrize("radius", [8, None])
def test_near_broadcasts_nothing(spark, monkeypatch, radius):
    i = F.col("id")
    df = spark.range(300).select(i.cast("string").alias("path"), (i % 200).cast("string").alias("fingerprint"), F.lpad(F.hex(i % 200), 16, "0").alias("hash"), F.lit(0.5).alias("quality"))
    assert _broadcasts(monkeypatch, lambda: duplicates.near(df, radius)) == 0


def test_duplicate_peers_keys_are_not_broadcast(spark, sf_dir, monkeypatch):
    plans, save = {}, Tables.save
    monkeypatch.setattr(Tables, "save", lambda self, df, name: (plans.update({name: df._jdf.queryExecution().sparkPlan().toString()}), save(self, df, name))[1])
    assert catalogue.duplicate_peers(spark, sf_dir).count() > 0
    for name in ("close", "edges"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]


def test_duplicate_peers_hashes_documents_once(spark, sf_dir, monkeypatch):
    plans, save = [], Tables.save
    monkeypatch.setattr(Tables, "save", lambda self, df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), save(self, df, name))[1])
    assert catalogue.duplicate_peers(spark, sf_dir).count() > 0
    assert sum(x.count("explode(split(") for x in plans) == 1


def test_duplicate_peers_repeated_rows(spark, tmp_path):
    rows = [(1, "one two three", "web"), (2, "one two three", "web"), (2, "one two three", "web"), (3, " ".join(f"w{i}" for i in range(300)), "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = catalogue.duplicate_peers(spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, found)) == [("web/00000002", "rejected")] * 2


def test_duplicate_peers_result_broadcasts_nothing(spark, sf_dir):
    assert "Broadcast" not in catalogue.duplicate_peers(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()


def test_peers_of_one_item(spark):
    rows = [("a", 0.5, "g", "rejected"), ("b", 0.9, "g", "rejected"), ("c", 0.1, "g", "selected"), ("d", 0.9, "h", "selected"), ("e", 0.2, None, "selected"), ("f", 0.3, None, "selected")]
    df = spark.createDataFrame(rows, "path string, quality double, duplicate_group string, category string")
    assert [r.path for r in duplicates.peers(df, "a").collect()] == ["c", "b"]
    assert [duplicates.peers(df, x).count() for x in ("d", "e", "missing", None)] == [0] * 4


@pytest.mark.parametrize("seed", range(3))
def test_near_is_the_sequential_scan(spark, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(3)]
    prints = [(f"fp{i}", base[i % 3] ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 7))), rnd.randint(0, 3) / 10) for i in range(40)]
    rows = [(f"p{i:03d}", *prints[rnd.randrange(40)]) for i in range(60)]
    rows = [(p, f, "" if f == "fp1" else f"{h:016x}", q) for p, f, h, q in rows]
    reps, wanted = [], {}
    for p, f, h, q in sorted(rows, key=lambda r: (-r[3], r[0])):
        match = next((r for r in reps if r[1] == f), None) or next((r for r in reps if h and r[2] and (int(h, 16) ^ int(r[2], 16)).bit_count() <= 8), None)
        wanted[p] = match[0] if match else None
        if not match:
            reps.append((p, f, h, q))
    df = spark.createDataFrame(rows, "path string, fingerprint string, hash string, quality double").repartition(3)
    found = {r.path: r.duplicate_of for r in duplicates.near(df, 8).collect()}
    assert found == wanted


def test_near_chain_and_none(spark):
    rows = [("a", "fa", f"{0:016x}", 0.9), ("b", "fb", f"{0xff:016x}", 0.8), ("c", "fc", f"{0xffff:016x}", 0.7)]
    df = spark.createDataFrame(rows, "path string, fingerprint string, hash string, quality double")
    assert {r.path: r.duplicate_of for r in duplicates.near(df, 8).collect()} == {"a": None, "b": "a", "c": None}
    assert {r.group_id for r in duplicates.near(df, None).collect()} == {None}
    assert duplicates.near(df.limit(0), 8).count() == 0


def _candidates(rnd, n, tied):
    cell = lambda k: f"c{rnd.randrange(k)}"
    value = (lambda: rnd.choice([0.2, 0.5, 0.9])) if tied else rnd.random
    return pd.DataFrame({
        "collection": "x", "path": [f"p{i:03d}" for i in rnd.sample(range(999), n)], "quality": [value() for _ in range(n)], "match": [value() for _ in range(n)],
        **{b: [rnd.choice([cell(4), ""]) for _ in range(n)] for b in selection.BUCKETS},
        "vec": [rnd.choice([[], [0.0, 0.0], [rnd.choice([-1.0, 0.0, 1.0]), rnd.choice([0.5, 1.0])]]) for _ in range(n)]})


def _naive(pdf, weights, target, forced=()):
    unit = [np.array(v) / np.linalg.norm(v) if len(v) and any(v) else None for v in pdf["vec"]]
    chosen = []
    while len(chosen) < min(target, len(pdf)):
        best = None
        for i in range(len(pdf)):
            if i in chosen or len(chosen) < len(forced) and pdf["path"][i] != forced[len(chosen)]:
                continue
            near = max([0.0, *(float(np.floor(unit[i] @ unit[j] * 1e6 + 0.5) / 1e6) for j in chosen if unit[i] is not None and unit[j] is not None)])
            v = 0.0
            for w, t in zip(weights, [pdf["quality"][i], pdf["match"][i], 1.0 - near, *(1.0 / (1.0 + sum((pdf[b][j] or "unknown") == (pdf[b][i] or "unknown") for j in chosen)) for b in selection.BUCKETS)]):
                v += w * t
            if best is None or (-v, pdf["path"][i]) < best[:2]:
                best = (-v, pdf["path"][i], i)
        chosen.append(best[2])
    return [pdf["path"][i] for i in chosen]


@pytest.mark.parametrize("seed", range(8))
def test_lazy_is_naive(seed):
    rnd = random.Random(seed)
    pdf = _candidates(rnd, 30, seed % 2 == 0)
    for profile, w in PROFILES.items():
        forced = sorted(rnd.sample(pdf["path"].tolist(), 2)) if profile == "quality" else []
        assert [pdf["path"][i] for i, *_ in selection.greedy(pdf, w, 12, forced)] == _naive(pdf, w, 12, forced)


def test_scans_are_the_kernel(spark):
    pdf = _candidates(random.Random(5), 25, True)
    df = spark.createDataFrame(pdf, "collection string, path string, quality double, match double, pose string, expression string, appearance string, scene string, session string, vec array<double>").repartition(3)
    choice = Choice(11)
    one = {r.path: (r.pick, r.value) for r in selection.select(df, choice, ["p" + pdf["path"][3][1:]]).collect()}
    two = {r.path: (r.pick, r.value) for r in selection.select(df, choice, ["p" + pdf["path"][3][1:]], kernel_rows=5).collect()}
    assert one == two and len(one) == 11
    assert selection.select(df, Choice(0)).count() == 0
    assert selection.select(df, Choice(99)).count() == 25
    two = df.withColumn("collection", F.lit("y")).withColumn("path", F.concat(F.lit("y"), "path")).unionByName(df)
    forced = ["y" + pdf["path"][1], pdf["path"][2], "y" + pdf["path"][4]]  # each collection takes its own
    kernel, scans = ({(r.collection, r.path, r.pick) for r in selection.select(two, choice, forced, kernel_rows=k).collect()} for k in (99, 5))
    assert kernel == scans and {("y", forced[0], 1), ("y", forced[2], 2), ("x", forced[1], 1)} <= kernel
    with pytest.raises(ValueError):
        selection.select(df, choice, ["nowhere"])
    with pytest.raises(ValueError):
        selection.select(df, Choice(1), pdf["path"].tolist()[:2])


def test_a_hundred_picks(spark):
    pdf = _candidates(random.Random(6), 130, True)
    df = spark.createDataFrame(pdf, "collection string, path string, quality double, match double, " + ", ".join(f"{b} string" for b in selection.BUCKETS) + ", vec array<double>").repartition(3)
    found = [r.path for r in selection.select(df, Choice()).orderBy("pick").collect()]
    assert len(found) == 100 and found == [pdf["path"][i] if isinstance(i, int) else i for i in _naive(pdf, Choice().weights, 100)]


@pytest.mark.parametrize("large", ["x", None])
def test_select_null_collection(spark, large):
    rnd = random.Random(21)
    both = _candidates(rnd, 28, False)
    both["collection"] = ([large] * 20 + ["x" if large is None else None] * 8)
    df = spark.createDataFrame(both.astype(object).where(both.notna(), None), "collection string, path string, quality double, match double, " + ", ".join(f"{b} string" for b in selection.BUCKETS) + ", vec array<double>")
    choice = Choice(5)
    one = {(r.collection, r.path, r.pick) for r in selection.select(df, choice).collect()}
    two = {(r.collection, r.path, r.pick) for r in selection.select(df, choice, kernel_rows=10).collect()}
    assert one == two and len(one) == 10


def test_gates_order_and_limits(spark):
    rows = [("a", True, 1, 0.9, 0.9), ("b", False, 0, 0.9, 0.9), ("c", False, 2, 0.1, 0.1), ("d", False, 1, 0.71, 0.1), ("e", False, 1, 0.72, 0.29), ("f", False, 1, 0.72, 0.30), ("g", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, invalid boolean, subjects int, match double, quality double")
    found = {r.path: r.reason_code for r in gates.gated(df, Limits()).collect()}
    assert found == {"a": "INVALID", "b": "INVALID", "c": "MULTI_SUBJECT", "d": "LOW_MATCH", "e": "LOW_QUALITY", "f": None, "g": "INVALID"}
    assert {r.path: r.reason_code for r in gates.gated(df, Limits(alone=False)).collect()}["c"] == "LOW_MATCH"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([1.0, 0.0], [-1.0, 0.0]), ([], [1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(F.round(vectors.cosine_or_zero(F.col("a"), F.col("b")), 6)).collect()] == [1.0, -1.0, 0.0, 0.0]
    assert vectors.centroid(df.limit(1), "a").first()[0] == pytest.approx([0.6, 0.8])
    for bad in (df.where("size(a) = 0"), df.limit(0), spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "a array<double>")):
        with pytest.raises(Exception):  # noqa: B017
            vectors.centroid(bad, "a").collect()


def test_reference_warnings(spark):
    make = lambda vs: spark.createDataFrame(list(enumerate(vs)), "vec_id int, vec array<double>")
    warn = lambda vs: matching.reference_summary(make(vs), "vec_id").first()
    assert warn([[1.0, 0.0]]).warning == "few_references" and warn([[1.0, 0.0]]).lowest is None
    assert warn([[1.0, 0.0], [-1.0, 0.1]]).warning == "inconsistent"
    assert warn([[1.0, 0.0], [1.0, 0.1]]).warning is None
    assert warn([[1.0, 0.1 * i] for i in range(6)]).warning == "many_references"


def test_calibration_brute_force(spark):
    rnd = random.Random(3)
    for _ in range(4):
        samples = [(rnd.choice([round(rnd.uniform(-0.2, 1.2), 2), 0.5]), rnd.random() < 0.5) for _ in range(25)] + [(0.9, True), (0.1, False)]
        values = sorted({min(1.0, max(0.0, s)) for s, _ in samples})
        best = None
        for t in [0.0, *((a + b) / 2 for a, b in zip(values, values[1:])), 1.0]:
            tp, fp = sum(s >= t and x for s, x in samples), sum(s >= t and not x for s, x in samples)
            p = sum(x for _, x in samples)
            n = len(samples) - p
            key = ((tp / p + (n - fp) / n) / 2, tp / max(1, tp + fp), tp / p)
            if best is None or key > best[0]:
                best = (key, t, tp, fp)
        got = calibration.best_threshold(spark.createDataFrame(samples, "score double, label boolean")).first()
        assert (got.threshold, got.true_positive, got.false_positive) == (round(best[1], 6), best[2], best[3])
    nulls = spark.createDataFrame([(0.9, True), (0.1, False), (None, True), (0.5, None)], "score double, label boolean")
    assert calibration.best_threshold(nulls).first().samples == 2
    with pytest.raises(Exception):  # noqa: B017
        calibration.best_threshold(spark.createDataFrame([(0.5, True)], "score double, label boolean")).collect()


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(scalars.duration_text(F.lit(s))) for s in (42, 125, 3725)] == ["42s", "2m 05s", "1h 02m"]
    assert [one(scalars.batch_size(F.lit(m))) for m in (4096, 8192, 16376, 24576)] == [2, 4, 8, 12] and one(scalars.batch_size(F.lit(None).cast("int"))) == 4
    assert [scalars.worker_count(n) for n in (1, 4, 16)] == [2, 3, 8]
    assert one(scalars.signature(F.array().cast("array<double>"))) == "unknown"
    assert one(scalars.session_key(F.lit("x.png"), F.lit("s"), F.lit("a"))) == "root|s|a"
    assert one(scalars.accelerator_metrics(F.lit("1, 2, 3"))) is None
    assert one(scalars.contains_all(F.lit(""), F.lit("x"))) is True and one(scalars.contains_all(F.lit("b A"), F.lit("xAyB"))) is True
    assert one(progress.smoothed(F.array(F.lit(4.0), F.lit(8.0)))) == 5.0
    assert one(matching.largest_subject(F.array(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0)))))) == [0.0, 0.0, 2.0, 2.0]
    with pytest.raises(Exception):  # noqa: B017
        one(scalars.parse_label(F.lit("maybe")))


def test_cache(spark):
    work = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "path string, fingerprint string")
    store = spark.createDataFrame([("old", "1", "v1", 7), ("old", "2", "v0", 8)], "path string, fingerprint string, analyzer string, written int")
    assert {(r.path, r.written) for r in cache.hits(work, store, "v1").collect()} == {("a", 7), ("b", 7)}
    assert {(r.fingerprint, r.path) for r in cache.misses(work, store, "v1").collect()} == {("2", "c"), ("3", "d")}
    new = spark.createDataFrame([("n", "1", "v1", 1), ("n", "1", "v1", 2)], "path string, fingerprint string, analyzer string, written int")
    assert {(r.fingerprint, r.analyzer, r.written) for r in cache.upserted(store, new).collect()} == {("1", "v1", 2), ("2", "v0", 8)}


def test_files_and_journal(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("in/A.JPG", b"x"), ("in/sub/b.png", b"y"), ("in/c.txt", b"z")):
        (tmp_path / name).write_bytes(data)
    found = files.fingerprint(files.discover(spark, f"file://{tmp_path}/in", content=True)).orderBy("path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["A.JPG", "b.png"] and len(found[0].fingerprint) == 64
    assert [r.item_index for r in files.indexed(files.discover(spark, f"file://{tmp_path}/in")).orderBy("path").collect()] == [1, 2]
    bad = files.decoded(spark, f"file://{tmp_path}/in/sub").collect()
    assert [r.valid for r in bad] == [False]
    (tmp_path / "l.csv").write_text("﻿score,same\n0.9, Yes\n0.1,no\n,yes\n", encoding="utf-8")
    assert [tuple(r) for r in files.labelled_samples(spark, f"file://{tmp_path}/l.csv", "score", "same").collect()] == [(0.9, True), (0.1, False)]
    assert files.labelled_samples(spark, f"file://{tmp_path}/l.csv", "quality", "same").count() == 0
    with pytest.raises(ValueError):
        files.labelled_samples(spark, f"file://{tmp_path}/l.csv", "quality", "same", required=True)
    with pytest.raises(Exception):  # noqa: B017  one row has no score
        files.labelled_samples(spark, f"file://{tmp_path}/l.csv", "score", "same", required=True).collect()
    (tmp_path / "j.json").write_text('{"run_id":"a","written":"2024-01-01T00:00:00","status":"failed","source":"s","config":"c","analyzer":"v"}\nbroken\n{"run_id":"a","written":"2024-01-02T00:00:00","status":"cancelled","source":"s","config":"c","analyzer":"v"}\n')
    states = journal.read(spark, f"file://{tmp_path}/j.json")
    assert [r.status for r in journal.resumable(states, "s", "c", "v").collect()] == ["cancelled"] and journal.resumable(states, "s", "c", "w").count() == 0

    def analyse(pdf):
        if (pdf["id"] == 1).any():
            raise RuntimeError("model")
        return pdf.assign(ok=True)

    boom = files.analysed(spark.range(3).repartition(1), analyse, "id long, ok boolean", lambda pdf: pdf.assign(ok=False)).orderBy("id").collect()
    assert [r.ok for r in boom] == [True, False, True]


def test_reports(spark, tmp_path):
    rows = [("in/a/x.png", "f1" * 8, "selected", 1), ("in/b/x.png", "f2" * 8, "rejected", 2), ("in/c/x.png", "f3" * 8, "rejected", 3)]
    items = spark.createDataFrame(rows, "path string, fingerprint string, category string, item_index long")
    plan = {r.path: r.destination for r in reports.destinations(items).collect()}
    assert plan["in/a/x.png"] == "selected/0001_x.png" and plan["in/b/x.png"] == "rejected/x.png" and len(set(plan.values())) == 3
    assert reports.destinations(items, copy_rejected=False).count() == 1
    assert reports.to_copy(reports.destinations(items), reports.destinations(items).where("category = 'rejected'")).count() == 1
    need = spark.createDataFrame([(10,), (30,), (20,)], "size_bytes long")
    assert reports.space_needed(need, 2, False).first().copy_bytes == 50
    with pytest.raises(OSError):
        reports.check_space(need, 2, True, 1)
    with pytest.raises(ValueError):
        reports.check_output("/a/b", "/a/b/c")
    page = reports.html_page(spark.createDataFrame([("<x>", 1.0, 1, ["a & b"])], "path string, value double, item_index int, reasons array<string>"), "t", 5)
    assert "&lt;x&gt;" in page and "a &amp; b" in page
    reports.write_csv(items.withColumn("reasons", F.array(F.lit("a"), F.lit("b"))), f"file://{tmp_path}/csv")
    back = spark.read.option("header", "true").csv(f"file://{tmp_path}/csv")
    assert back.columns == list(reports.CSV_COLUMNS) and {r.reasons for r in back.collect()} == {"a; b"}
    assert {tuple(r) for r in reports.changed(items, items.withColumn("category", F.lit("rejected"))).collect()} == {("in/a/x.png", "selected", "rejected")}
    assert {f.read_bytes()[:7] for f in (tmp_path / "csv").glob("*.csv")} == {b"\xef\xbb\xbfpath"}


def test_report(spark, tmp_path):
    items = spark.createDataFrame([("a", "selected", 0.9), ("b", "rejected", 0.1), ("c", "rejected", None)], "path string, category string, match double")
    stats = matching.statistics(items.withColumn("subjects", F.lit(1)), 0.5)
    reports.write_report(items, f"file://{tmp_path}/report", Policy().text(), stats, performance={"seconds": 2}, review={"added": ["x"]})
    head = json.loads("".join(r.value for r in spark.read.text(f"file://{tmp_path}/report/head").collect()))
    assert head["summary"] == {"selected": 1, "rejected": 2} and head["match_statistics"]["passed"] == 1 and head["policy"]["choice"]["count"] == 100
    assert head["performance"] == {"seconds": 2} and head["review"] == {"added": ["x"]} and head["references"] == {}
    assert spark.read.json(f"file://{tmp_path}/report/items").count() == 3


def test_manifest_and_review(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    root, n = f"file://{tmp_path}/out", 60
    for i in range(n):
        (tmp_path / f"src/{i:02d}.png").write_bytes(b"x" * (i + 1))
    (tmp_path / "src/sub/05.png").write_bytes(b"another")
    paths = [f"file://{tmp_path}/src/{i:02d}.png" for i in range(n)] + [f"file://{tmp_path}/src/sub/05.png"]
    make = lambda chosen: spark.createDataFrame([(p, f"{i:08x}f", "selected" if i in chosen else "rejected", i + 1) for i, p in enumerate(paths)], "path string, fingerprint string, category string, item_index long").repartition(2)
    before = make({0, 1})
    broken = before.where("item_index <= 45").unionByName(spark.createDataFrame([(f"file://{tmp_path}/src/none.png", "f", "selected", 99)], before.schema)).repartition(1).sortWithinPartitions("item_index")
    with pytest.raises(Exception):  # noqa: B017  a file is missing
        reports.materialize(reports.destinations(broken).coalesce(1), root)
    known = reports.read_manifest(spark, root).count()
    assert known > 0  # what was copied before the failure is written down
    assert reports.materialize(reports.destinations(before), root) == n + 1 - known and reports.materialize(reports.destinations(before), root) == 0
    held = {r.path: r.destination for r in reports.read_manifest(spark, root).collect()}
    assert held[paths[0]] == "selected/0001_00.png" and len(set(held.values())) == n + 1
    assert all((tmp_path / "out" / held[p]).stat().st_size == len((tmp_path / p.split(str(tmp_path) + "/")[1]).read_bytes()) for p in paths)
    reports.write_report(before, f"{root}/report", Policy().text())
    assert reports.sync_review(before, make({0, 2}), root, 1) == 2
    held = {r.path: r.destination for r in reports.read_manifest(spark, root).collect()}
    assert held[paths[1]] == "rejected/01.png" and held[paths[2]] == "selected/0003_02.png"
    assert not (tmp_path / "out/selected/0002_01.png").exists() and (tmp_path / "out/rejected/01.png").read_bytes() == b"xx" and (tmp_path / "out/history/1/report/head").is_dir()
    assert reports.sync_review(make({0, 2}), make({0}), root, 2, copy_rejected=False) == 1
    assert (tmp_path / "out/history/2/removed/selected/0003_02.png").read_bytes() == b"xxx" and paths[2] not in {r.path for r in reports.read_manifest(spark, root).collect()}


def test_review_leaves_other_copies(spark, tmp_path):
    """An item takes the name of one that moves away in the same revision."""
    root = f"file://{tmp_path}/out"
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.png").write_bytes(folder.encode())
    make = lambda a, b: spark.createDataFrame([(f"file://{tmp_path}/a/x.png", "aaaaaaaa1", a, 1), (f"file://{tmp_path}/b/x.png", "bbbbbbbb1", b, 2)], "path string, fingerprint string, category string, item_index long")
    one, two = make("rejected", "other"), make("other", "rejected")
    assert reports.materialize(reports.destinations(one), root) == 2 and reports.sync_review(one, two, root, 1) == 2
    held = {r.path[-7]: (tmp_path / "out" / r.destination).read_bytes() for r in reports.read_manifest(spark, root).collect()}
    assert held == {"a": b"a", "b": b"b"}


def test_numbered_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i) for i in range(300)]
    found = files.numbered(spark.createDataFrame(rows, "g string, i long").repartition(5), ["g"], "i", "nth").collect()
    order = {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        order[g, i] = sum(1 for a, b in rows if a == g and b <= i)
    assert {(r.g, r.i): r.nth for r in found} == order


def test_smoothed_rates(spark):
    rnd = random.Random(4)
    rows = [(u, i, rnd.random() * 9) for u, n in (("a", 1), ("b", 700), (None, 5)) for i in range(n)]
    found = {r.u: r.smoothed for r in progress.smoothed_rates(spark.createDataFrame(rows, "u string, i int, x double").repartition(3), "u", "i", "x").collect()}
    for u in ("a", "b", None):
        s = None
        for _, _, x in [r for r in rows if r[0] == u]:
            s = x if s is None else 0.25 * x + 0.75 * s
        assert found[u] == pytest.approx(s, rel=1e-12)


def test_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from gleaner.sources.store import shared_root

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: {"spark.master": "yarn"}.get(k, d)))
    with pytest.raises(ValueError):
        shared_root(cluster)
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_review_rules(spark):
    rows = [("a", "selected", None, 1, 0.9), ("b", "rejected", "REDUNDANT", None, 0.8), ("c", "rejected", "LOW_MATCH", None, 0.7), ("d", "rejected", "REDUNDANT", None, 0.1)]
    df = spark.createDataFrame(rows, "path string, decision string, reason_code string, pick int, quality double")
    df = df.withColumns({"collection": F.lit("x"), "match": F.lit(0.9), "value": F.lit(None).cast("double"), "forced": F.lit(False), "vec": F.array().cast("array<double>"), **{b: F.lit("u") for b in selection.BUCKETS}})
    choice = Choice(1)
    found = {r.path: (r.decision, r.reason_code, r.note) for r in review.edited(df, choice, include="d", exclude="a").collect()}
    assert found == {"a": ("rejected", "MANUAL", "EXCLUDED"), "b": ("rejected", "REDUNDANT", None), "c": ("rejected", "LOW_MATCH", None), "d": ("selected", None, "INCLUDED")}
    moved = review.edited(df, choice, include="d").withColumn("duplicate_of", F.lit(None).cast("string"))
    assert {r.path: r.note for r in moved.collect()} == {"a": "DISPLACED", "b": None, "c": None, "d": "INCLUDED"}
    said = {r.path: r.reasons[0] for r in curation.reasons(moved.withColumn("pick", F.lit(1))).collect()}
    assert "edit by hand" in said["a"] and said["b"] == "redundant"
    unknown = df.withColumn("match", F.lit(None).cast("double"))
    assert review.filtered(unknown).count() == 4 and review.filtered(unknown, minimum_match=0.1).count() == 0
    for bad in ({"include": "c"}, {"exclude": "b"}, {"include": "a", "exclude": "a"}, {"include": "nowhere"}):
        with pytest.raises(ValueError):
            review.edited(df, choice, **bad)
    assert review.filtered(df, "no such view").count() == 4 and [r.path for r in review.filtered(df, "REDUNDANT", 0, 0.5).collect()] == ["b"]


def test_ingest(spark, tmp_path):
    from gleaner.streaming import ingest

    spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "path string, fingerprint string").write.parquet(f"file://{tmp_path}/in")
    analyse = lambda df: df.select("fingerprint", F.lit("v1").alias("analyzer"), F.lit(1).alias("feature"))
    for _ in range(2):
        stream = ingest.arriving(spark, f"file://{tmp_path}/in", spark.read.parquet(f"file://{tmp_path}/in").schema)
        ingest.analyse_into_cache(stream, f"file://{tmp_path}/cache", "v1", analyse, f"file://{tmp_path}/ck{_}").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/cache").count() == 2


def test_pixels(spark, tmp_path):
    import struct
    import zlib

    from gleaner.functions import pixels

    rnd = np.random.default_rng(1)
    image = rnd.integers(0, 256, (40, 50, 3), np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in image)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 50, 40, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    (tmp_path / "b.png").write_bytes(b"no image")
    found = pixels.features(files.decoded(spark, f"file://{tmp_path}")).collect()
    assert len(found) == 1
    wanted = pixels.features_of(image.astype(float))
    assert (found[0].width, found[0].height, found[0].hash) == (50, 40, wanted["hash"]) and found[0].edge_variance == pytest.approx(wanted["edge_variance"])
    assert len(found[0].descriptor) == 48 and all(0 <= x <= 1 for x in found[0].descriptor)
    flat, blocks = np.full((32, 32), 90.0), np.kron(np.indices((4, 4)).sum(axis=0) % 2 * 80.0, np.ones((8, 8)))
    assert pixels.block_artifact(flat) == 0.0 and pixels.block_artifact(blocks) == 1.0 and pixels.block_artifact(flat[:8]) == 0.0
    assert pixels.edge_variance(flat) == 0.0 and (pixels.resized(flat, 8, 8) == 90).all()
