"""Token files: Parquet list columns with selective reads, and flat files that a separator scan counts.

*Parquet.*  ``write_parquet`` encodes whole texts with the tokenizers library, appends the end id and writes
(doc_id, part, local_start, n_tokens, ids) in ascending doc_id order: files are ranges of doc_id and sorted inside.  Ids
are dictionary- or delta-encoded, row groups and pages have set sizes, and page indexes let ``read_tokens`` skip to
the pages of a range of doc_ids and ``read_metadata`` leave the ids unread.

*Flat.*  ``write_flat`` writes bare little-endian ids (uint16 or uint32), each document followed by the end id, with
no index.  ``scan_separators`` finds the end ids block by block with vectorised comparison; where documents run across
blocks, a prefix scan over the blocks' counts and last ends stitches them together.

Cases: null text is empty, so its document is the end id alone; repeated doc_ids are documents in a row, ordered by
text; null doc_ids come first; an empty table gives files without documents; ids after a flat file's last end id are
one document marked as not ended.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import CACHES, Workspace, binary_list, in_batches, parallelism
from .pieces import LETTERS, spaced

END_ID = 2
#: Strings whose ids a worker keeps, at some 150 bytes each.
CACHED_WORDS = 1_000_000
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: Bytes of a flat file that one scan step reads.
BLOCK_BYTES = 4 << 20


class WordEncoder(dict):
    """Whole texts through the tokenizers library, each distinct pre-token once; maps one to its packed ids.

    Only for tokenizers that lower-case and drop white space: there a text's ids are its pre-tokens' ids in a
    row (see pieces.py).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        alone = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("ab", "cd", ".")]
        if self.tokenizer.encode("AB \n cd.", add_special_tokens=False).ids != sum(alone, []):
            raise ValueError("a tokenizer that lower-cases and drops white space is needed")
        vocabulary = self.tokenizer.get_vocab(True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for text, i in vocabulary.items() if text.endswith("</w>")]] = True

    def learn(self, pieces: set[bytes]) -> None:
        """Pieces of letters are one pre-token each and go through many to a call, told apart by end-of-word ids."""
        letters = [p for p in pieces if p.isalpha() or LETTERS.fullmatch(p)]
        for a in range(0, len(letters), 2000):
            some = letters[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cuts) != len(some) + 1:
                raise ValueError("the tokenizer splits letters")
            raw = ids.tobytes()
            self.update(zip(some, [raw[i:j] for i, j in zip(cuts, cuts[1:])]))
        rest = list(pieces.difference(letters))
        found = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in rest], add_special_tokens=False)
        self.update((p, struct.pack(f"<{len(e.ids)}I", *e.ids)) for p, e in zip(rest, found))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, each text's followed by ``end``, and how many each has.

        Arrow cuts a batch and numbers its distinct strings; only those are looked up one by one.
        """
        if len(self) > CACHED_WORDS:
            self.clear()
        cut = pc.ascii_split_whitespace(pa.array([spaced(t) for t in texts], pa.binary()).view(pa.string()))
        flat = cut.flatten().dictionary_encode()
        strings = _strings(flat.dictionary)
        ids = list(map(self.get, strings))
        new = [i for i, x in enumerate(ids) if x is None]
        self.learn({strings[i] for i in new})
        for i in new:
            ids[i] = self[strings[i]]
        ids.append(struct.pack("<I", end))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, table = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), np.uint32)
        at = cut.offsets.to_numpy().astype(np.int64)
        which = np.insert(flat.indices.to_numpy(), at[1:] - at[0], len(strings))
        many = sizes[which]
        done = np.cumsum(many)
        out = table[np.repeat(first[which] - (done - many), many) + np.arange(done[-1] if len(done) else 0)]
        last = done[at[1:] - at[0] + np.arange(len(texts))]
        return out, np.diff(np.r_[0, last])


def _strings(words: pa.Array) -> list[bytes]:
    """The words, none of which holds a space, as bytes; one split is faster than a conversion word by word."""
    if not len(words):
        return []
    row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(row, " ")[0].as_buffer().to_pybytes().split(b" ")


@cache
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


CACHES.append(encoder.cache_clear)

TOKENS = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, words = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in in_batches(batches, "text", 4 << 20):
            flat, sizes = words.encode(binary_list(batch.column("text")), end_id)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(done + ends - sizes), pa.array(sizes), ids], ["doc_id", "part", "local_start", "n_tokens", "ids"])
            done += int(ends[-1])

    return scan


def write_parquet(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, delta: bool = False,
                  row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Token files of ``docs`` (doc_id, text) under ``path``; delta: ids delta-encoded rather than by dictionary."""
    ordered = docs.select("doc_id", "text").repartitionByRange(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), TOKENS).write
        .option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows).option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(not delta).lower()).parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document; the ids stay unread."""
    return with_starts(spark.read.schema(TOKENS).parquet(path)).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of documents from ``low`` to ``high``; both ends reach the page indexes."""
    rows = spark.read.schema(TOKENS).parquet(path)
    rows = rows if low is None else rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def with_starts(rows: DataFrame) -> DataFrame:
    """``start``: ids of all documents before; one sum for each file is added up, as many as files were written."""
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    base = parts.select("part", F.coalesce(F.sum("own").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        raw, at = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)), ids.offsets.to_numpy()
        view = memoryview(raw).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids in the files."""
    return with_starts(read_tokens(spark, path)).select("doc_id", "start", "ids").mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


# flat files


def _files(uri: str):
    """The file system of ``uri`` and the path in it, for any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub("^file:", "", uri))


def _write_flat(folder: str, tokenizer: str, end_id: int, dtype: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, path = _files(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        words, count = encoder(tokenizer), 0
        with store.open_output_stream(f"{path}/{name}") as out:
            for batch in in_batches(batches, "text", 4 << 20):
                ids, sizes = words.encode(binary_list(batch.column("text")), end_id)
                n = len(sizes)
                if np.count_nonzero(ids == end_id) != n:
                    raise ValueError(f"a text holds the end id {end_id}")
                out.write(ids.astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(count, count + n)), batch.column("doc_id")], ["file", "doc_no", "doc_id"])
                count += n

    return scan


def write_flat(ws: Workspace, docs: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u2") -> tuple[str, DataFrame]:
    """The folder of flat files, one for each scan task, and (file, doc_no, doc_id): who is the n-th document of a file.

    Only files named there count: those of lost or repeated task attempts are never listed.
    """
    folder = f"{ws.path}/flat"
    jvm = ws.spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(ws.spark._jsc.hadoopConfiguration()).mkdirs(at)
    return folder, ws.save(docs.select("doc_id", "text").mapInArrow(_write_flat(folder, tokenizer, end_id, dtype), "file string, doc_no long, doc_id long"), "manifest", by_partition=True)


def _blocks(folder: str, width: int, block_bytes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                size = store.get_file_info(f"{path}/{name}").size
                if size % width:
                    raise ValueError(f"{name} is cut off")
                n = max(1, -(-size // block_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n, dtype=np.int64) * block_bytes), pa.array(np.minimum(block_bytes, size - np.arange(n, dtype=np.int64) * block_bytes))], ["file", "at", "size"])

    return scan


def _separators(folder: str, end_id: int, dtype: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
                with store.open_input_file(f"{path}/{name}") as f:
                    ids = np.frombuffer(f.read_at(size, at), dtype)
                ends = np.flatnonzero(ids == end_id) + at // width
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // width]), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "first", "n", "ends"])

    return scan


def scan_separators(ws: Workspace, folder: str, files: DataFrame, end_id: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, doc_no, start, n_tokens, ended) of every document of the flat ``files`` (file); n_tokens counts the end id."""
    width = np.dtype(dtype).itemsize
    if block_bytes % width:
        raise ValueError("a block holds whole ids")
    n = parallelism(ws.spark)
    blocks = files.repartition(n, "file").mapInArrow(_blocks(folder, width, block_bytes), "file string, at long, size long").repartition(n, "file", "at")
    found = ws.save(blocks.mapInArrow(_separators(folder, end_id, dtype), "file string, first long, n long, ends array<long>"), "ends")
    before = W.partitionBy("file").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    carried = found.select(  # the prefix scan: documents and the last end before each block
        "file", "first", "n", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs"),
        F.coalesce(F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1))).over(before) + 1, F.lit(0)).alias("open"))
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    ended = carried.select("file", "docs", F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size("ends")).alias("start"), F.col("ends").alias("end"))).alias("k", "d"))
    whole = ended.select("file", (F.col("docs") + F.col("k")).alias("doc_no"), F.col("d.start").alias("start"), (F.col("d.end") + 1 - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    last = found.groupBy("file").agg(F.sum(F.size("ends")).alias("doc_no"), F.coalesce(F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1))) + 1, F.lit(0)).alias("start"), F.max(F.col("first") + F.col("n")).alias("total"))
    rest = last.where("total > start").select("file", "doc_no", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)
