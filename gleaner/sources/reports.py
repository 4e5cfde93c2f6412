"""Results on disk: where items go, reports, space needed, and what a revision changed."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import numbered

CSV_COLUMNS = ("path", "decision", "reason_code", "value", "quality", "match", "expression", "blur", "occlusion", "artifact", "pose", "appearance", "scene", "session", "duplicate_group", "reasons")
#: Bytes that a run needs besides its copies: this many, or a share of the source.
RESERVE_BYTES, RESERVE_SHARE = 256 << 20, 0.05


def destinations(items: DataFrame, copy_rejected: bool = True) -> DataFrame:
    """(path, fingerprint, category, destination): selected names carry their input number; clashing names a piece of the hash.

    ``items``: path, fingerprint, category, item_index.  Different files never share a destination.
    """
    rows = items if copy_rejected else items.where("category = 'selected'")
    name = F.element_at(F.split("path", "/"), -1)
    plain = F.when(F.col("category") == "selected", F.concat(F.lpad(F.col("item_index").cast("string"), 4, "0"), F.lit("_"), name)).otherwise(name)
    return (
        numbered(rows.withColumn("plain", plain).withColumn("name", name), ["category", "plain"], "item_index", "nth")
        .select("path", "fingerprint", "category", F.concat("category", F.lit("/"), F.when(F.col("nth") == 1, F.col("plain")).otherwise(F.concat(F.substring("fingerprint", 1, 8), F.lit("_"), F.col("nth").cast("string"), F.lit("_"), F.col("name")))).alias("destination")))


MANIFEST = "path string, fingerprint string, destination string, revision long"
#: Copies after which a task writes down what it has done.
CHECKPOINT = 25


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, fingerprint, destination) of what lies under ``root``: the latest revision of each path counts, none without a destination."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, fingerprint string, destination string")
    rows = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    latest = rows.groupBy("path").agg(F.max_by(F.struct("fingerprint", "destination"), F.struct("revision", "destination")).alias("m"))
    return latest.select("path", "m.fingerprint", "m.destination").where("destination is not null")


def to_copy(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned copies that the manifest (path, fingerprint, destination) doesn't have yet."""
    return planned.join(manifest.select("path", "fingerprint", "destination"), ["path", "fingerprint", "destination"], "left_anti")


def _move_files(root: str, revision: int):
    """Rows (path, fingerprint, source, destination, target): the file at ``source`` goes to ``target`` under the root.

    Files come whole: each is copied under a temporary name and renamed.  A source under the root is moved.  What is done is
    written to the manifest after each CHECKPOINT files and at the end, also if a file fails, so a new run goes on from there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, done, files = TaskContext.get(), [], 0
        home, base = fs.FileSystem.from_uri(root)

        def flush() -> None:
            nonlocal done, files
            if done:
                home.create_dir(f"{base}/manifest", recursive=True)
                name = f"{base}/manifest/r{revision:06d}-{task.partitionId():06d}-{task.taskAttemptId()}-{files:06d}.json"
                with home.open_output_stream(name) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in done).encode())
                done, files = [], files + 1

        try:
            for rows in batches:
                for r in rows.itertuples():
                    store, at = fs.FileSystem.from_uri(r.source)
                    to, inside = f"{base}/{r.target}", r.source.startswith(root + "/")
                    here, there = store.get_file_info(at), home.get_file_info(to)
                    if not (there.is_file and (there.size == here.size or inside and not here.is_file)):  # else an earlier attempt did it
                        home.create_dir(to.rsplit("/", 1)[0], recursive=True)
                        fs.copy_files(at, f"{to}.part", source_filesystem=store, destination_filesystem=home)
                        home.move(f"{to}.part", to)
                    if inside and here.is_file and at != to:
                        home.delete_file(at)
                    done.append({"path": r.path, "fingerprint": r.fingerprint, "destination": r.destination, "revision": revision})
                    if len(done) >= CHECKPOINT:
                        flush()
                yield pd.DataFrame({"path": rows["path"]})
        finally:
            flush()

    return run


def materialize(planned: DataFrame, root: str, revision: int = 0) -> int:
    """Copy what the manifest lacks of ``planned`` (path, fingerprint, destination) under ``root``; the number of files copied.

    Paths and root are URIs of stores that all executors reach.
    """
    left = to_copy(planned, read_manifest(planned.sparkSession, root))
    left = left.select("path", "fingerprint", F.col("path").alias("source"), "destination", F.col("destination").alias("target"))
    return left.mapInPandas(_move_files(root, revision), "path string").count()


def sync_review(before: DataFrame, after: DataFrame, root: str, revision: int, copy_rejected: bool = True) -> int:
    """Bring the files under ``root`` in line with a revision; the number of files moved, copied or put away.

    before, after: path, fingerprint, category, item_index.  Only items whose category changed are touched: their copies move to the
    new category; what isn't to be copied any more is kept under history/<revision>, as are the reports so far.
    """
    spark = after.sparkSession
    held = read_manifest(spark, root).select("path", F.col("destination").alias("held"))
    moved = changed(before, after).select("path")
    planned = destinations(after, copy_rejected).join(moved, "path", "left_semi")
    name = F.element_at(F.split("path", "/"), -1)
    free = F.concat("category", F.lit("/"), F.substring("fingerprint", 1, 8), F.lit(f"_r{revision}_"), name)  # where another item's copy lies now
    taken = held.select(F.col("held").alias("destination"), F.lit(True).alias("taken"))
    wanted = planned.join(taken, "destination", "left").select("path", F.when(F.col("taken"), free).otherwise(F.col("destination")).alias("destination"))
    rows = after.join(moved, "path", "left_semi").select("path", "fingerprint").join(wanted, "path", "left").join(held, "path", "left")
    source = F.when(F.col("held").isNotNull(), F.concat(F.lit(f"{root}/"), "held")).otherwise(F.col("path"))
    away = F.concat(F.lit(f"history/{revision}/removed/"), "held")
    todo = rows.where("destination is not null or held is not null").select("path", "fingerprint", source.alias("source"), "destination", F.coalesce("destination", away).alias("target"))
    from .store import Tables

    todo = Tables(spark, "sync").save(todo, "todo")  # the manifest changes while files move
    jvm = spark._jvm
    for name in ("report", "report.csv"):
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(at):
            kept = jvm.org.apache.hadoop.fs.Path(f"{root}/history/{revision}/{name}")
            store.mkdirs(kept.getParent())
            store.rename(at, kept)
    return todo.mapInPandas(_move_files(root, revision), "path string").count()


def category_counts(items: DataFrame, category: str = "category") -> DataFrame:
    return items.groupBy(category).agg(F.count(F.lit(1)).alias("items"))


def write_report(items: DataFrame, path: str, policy: str, statistics: DataFrame | None = None, enrolment: DataFrame | None = None, performance: dict | None = None, review: dict | None = None, version: str = "1") -> None:
    """The JSON report: ``path``/head, one document on the run, and ``path``/items, a line for each item.

    head: version, written, the policy, items by category, and of what was given the match statistics and the references' summary
    (frames of one row each), the run's performance and the review.
    """
    spark = items.sparkSession
    one = lambda df: df.first().asDict(recursive=True) if df is not None else {}
    counts = {r.category: r["items"] for r in category_counts(items).collect()}  # one row for each category
    head = {
        "version": version, "written": datetime.now(timezone.utc).isoformat(), "policy": json.loads(policy), "summary": counts,
        "match_statistics": one(statistics), "references": one(enrolment), "performance": performance or {}, "review": review or {}}
    spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    items.write.mode("overwrite").json(f"{path}/items")


def write_json(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def write_csv(items: DataFrame, path: str) -> None:
    """The sixteen report columns, those missing as null, reasons joined by "; "; each file starts with a byte-order mark."""
    have = {c: F.array_join("reasons", "; ") if c == "reasons" else F.col(c) for c in items.columns if c in CSV_COLUMNS}
    rows = items.select(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in CSV_COLUMNS])
    rows.withColumnRenamed("path", "\ufeffpath").write.mode("overwrite").option("header", "true").csv(path)


def html_page(selected: DataFrame, title: str, most: int) -> str:
    """A page with a card for each selected item, highest value first; ``most`` is the policy's target."""
    rows = selected.orderBy(F.desc("value"), "item_index").limit(most).collect()
    cards = "".join(f"<article><h2>{html.escape(r.path)}</h2><p>{r.value:.3f}</p><ul>{''.join(f'<li>{html.escape(x)}</li>' for x in r.reasons or ())}</ul></article>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{len(rows)} selected</p>{cards}"


def space_needed(files: DataFrame, target_count: int, copy_rejected: bool) -> DataFrame:
    """One row: files, source, copy, reserve and required bytes; without rejected copies the largest ``target_count`` count."""
    total = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("source_bytes"))
    if copy_rejected:
        both = total.withColumn("copy_bytes", F.col("source_bytes"))
    else:
        top = files.orderBy(F.desc("size_bytes")).limit(max(target_count, 0)).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("copy_bytes"))
        both = total.join(F.broadcast(top))  # one row each
    reserve = F.greatest(F.lit(RESERVE_BYTES).cast("long"), F.floor(F.col("source_bytes") * F.lit(RESERVE_SHARE)).cast("long"))
    return both.withColumn("reserve_bytes", reserve).withColumn("required_bytes", F.col("copy_bytes") + F.col("reserve_bytes"))


def check_space(files: DataFrame, target_count: int, copy_rejected: bool, available: int) -> int:
    need = space_needed(files, target_count, copy_rejected).first().required_bytes
    if available < need:
        raise OSError(f"{need} bytes are needed and {available} are free")
    return need


def check_output(source: str, output: str) -> None:
    """The output must be outside the source."""
    a, b = source.rstrip("/") + "/", output.rstrip("/") + "/"
    if b.startswith(a):
        raise ValueError("the output lies in the source")


def changed(before: DataFrame, after: DataFrame, key: str = "path", value: str = "category") -> DataFrame:
    """(key, was, now) where a revision changed the value; missing on a side is null."""
    old, new = before.select(key, F.col(value).alias("was")), after.select(key, F.col(value).alias("now"))
    return old.join(new, key, "full").where(~F.col("was").eqNullSafe(F.col("now")))


def write_revision(items: DataFrame, path: str, revision: int) -> None:
    """Decisions of a revision beside the earlier ones."""
    items.withColumn("revision", F.lit(revision)).write.mode("append").partitionBy("revision").parquet(path)


def checksum_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, state) of files that are missing, unexpected or different; both sides: name, checksum."""
    both = expected.select("name", F.col("checksum").alias("wanted")).join(actual.select("name", F.col("checksum").alias("found")), "name", "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("wanted") != F.col("found"), "different")
    return both.select("name", state.alias("state")).where("state is not null")
