"""Near-duplicate groups by SimHash fingerprints and Burkhard-Keller trees.

A text is lower-cased (A-Z only) and cut into words at ASCII white space; each run of SHINGLE words, joined by one
space, is hashed by XXH64 (UTF-8, seed 42).  A bit of the fingerprint is 1 if it is set in over half the hashes.
Fewer words make one shingle of them all; no word gives fingerprint zero, which links like any other.

Fingerprints within ``radius`` bits are linked, exactly:

* Equal fingerprints are one node, so copies cost nothing.
* Nodes meet in blocks.  The 64 bits are cut into pieces; with ``pieces - radius`` pieces or fewer in a key, two
  fingerprints within the radius agree on some choice of that many pieces.  The scheme with the fewest keys
  whose blocks are expected to hold at most BLOCK_NODES is taken, for any number of nodes.
* In each block a BK-tree is built, its children keyed by Hamming distance to the parent, and each node
  follows only edges within the radius of its own distance.  A block of over TREE_NODES nodes is dealt to several tree
  shards, each of which every node of the block visits.
* A block gives a star for each local group of linked nodes, not all pairs; connected components join the stars.  A branch
  that is of the visitor's own group already is not followed, so a dense group costs far less than all its pairs.

``keep_similar`` looks for a given similarity (Jaccard, sets of five-word shingles).  Short shingles move few bits when a text is edited, so
documents first meet by fingerprints of two words within 8 bits, as above.  Those that meet any are blocked once more, now with
the 256-bit fingerprint of their five-word shingles, over which the trees are built: a link needs both, the second within the
distance expected at the similarity and one standard deviation.

Cases: null text has no word; repeated rows are one node; an empty table gives an empty result; null doc_ids are
reported and count as larger than any other, and a component of null doc_ids alone has a null component_id; repeated
doc_ids are told apart by their texts; very long texts are hashed in bounded pieces.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, binary_list, connected_components, dealt, flat_bytes, gathered, in_batches, parallelism, skew_safe_lookup

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Shingle and radius by which similar texts meet; shingle and words of 64 bits of the fingerprint by which they are judged.
MEET_SHINGLE, MEET_RADIUS, WIDE_SHINGLE, LANES = 2, 8, 5, 4
#: Expected nodes of a block; nodes of one tree; most (query, node) visits held at a time; shingles hashed at a time.
BLOCK_NODES, TREE_NODES, VISITS, PIECE = 1024, 20_000, 1 << 20, 1 << 16
#: Expected nodes of a block at the larger radius: more keys cost less there than more candidates.
MEET_NODES = 64
#: Keys of a node that are written at a time.
KEYS_AT_ONCE = 64
_LAST = (1 << 63) - 1


def _words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased words joined by one space, each one's start and end; bytes.split and bytes.lower know ASCII only."""
    words = text.lower().split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.r_[np.zeros(min(1, len(words)), np.int64), ends[:-1] + 1], ends


def _hashes(flat: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, PIECE at a time; fewer words make one shingle, no word none."""
    digest = xxhash.xxh64_intdigest
    n = max(1, len(starts) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(starts) >= shingle else ends[-1:]).tolist()
    for a in range(0, len(first), PIECE):
        yield np.array([digest(flat[i:j], SEED) for i, j in zip(first[a : a + PIECE], last[a : a + PIECE])], np.uint64)


def _fold(hashes: Iterable[np.ndarray], lanes: int) -> np.ndarray:
    """``lanes`` times 64 bits: 1 where over half the hashes have it, the first lane by the hashes, others by mixed ones."""
    ones, n = np.zeros((lanes, 64), np.int64), 0
    for h in hashes:
        n += len(h)
        for lane in range(lanes):
            ones[lane] += count_bits(_mixed(h, lane) if lane else h)
    return ((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    return int(_fold(_hashes(*_words(text), shingle), 1)[0])


def two_fingerprints(text: bytes, shingle: int = MEET_SHINGLE, wide: int = WIDE_SHINGLE) -> tuple[int, bytes]:
    """The fingerprint by which texts meet, and the wide one by which they are judged, both of distinct shingles."""
    words = _words(text)
    return int(_fold(_distinct(_hashes(*words, shingle)), 1)[0]), _fold(_distinct(_hashes(*words, wide)), LANES).tobytes()


def _distinct(hashes: Iterator[np.ndarray]) -> list[np.ndarray]:
    return [np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))]


def wide_radius(similarity: float) -> int:
    """Bits in which wide fingerprints may differ: those expected at the similarity and one standard deviation.

    Texts of similarity s and like length have a cosine of 2s / (1 + s), and a bit differs with probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * LANES
    return int(bits * p + math.sqrt(bits * p * (1 - p)))


_SPREAD = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.uint8)


def count_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit, lowest first: bits are added in bytes, 255 hashes at a time."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    blocks = len(bits) // 255
    out = bits[blocks * 255 :].sum(axis=0, dtype=np.int64)
    if blocks:
        out += np.add.reduce(bits[: blocks * 255].reshape(blocks, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def _fingerprints(shingle: int, wide: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, "text"):
            texts = binary_list(batch.column("text"))
            rest = [c for c in batch.schema.names if c != "text"]
            if wide:
                found, wides = zip(*[two_fingerprints(x, shingle, wide) for x in texts])
            else:
                found, wides = [text_fingerprint(x, shingle) for x in texts], None
            more = [pa.array(wides, pa.binary())] if wide else []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(np.array(found, np.uint64).view(np.int64)), *more], [*rest, "fp", *["wide"] * len(more)])

    return scan


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digests: bool = False, wide: int = 0) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row for each row of ``docs``.

    With ``digests`` the text's digest too, with ``wide`` the wide fingerprint of shingles of that many words.
    """
    also = [_text_digest().alias("digest")] if digests else []
    schema = "doc_id long, " + "digest binary, " * digests + "fp long" + ", wide binary" * bool(wide)
    return docs.select("doc_id", "text", *also).mapInArrow(_fingerprints(shingle, wide), schema)


def _text_digest():
    """SHA-256 of the whole text; null for null."""
    return F.unhex(F.sha2("text", 256))


def block_scheme(nodes: int, radius: int, block_nodes: int = BLOCK_NODES) -> tuple[int, int]:
    """(pieces, pieces in a key): the fewest keys whose blocks are expected to hold at most block_nodes."""
    for agree in range(1, 9):
        if nodes / 2 ** (64 * agree / (radius + agree)) <= block_nodes:
            break
    return radius + agree, agree


def block_keys(fp, pieces: int, agree: int, first: int = 0, most: int | None = None):
    """An array of keys: for each choice of pieces, or ``most`` from the ``first`` on, a hash of the choice and the fingerprint's bits there."""
    cuts = [round(64 * i / pieces) for i in range(pieces + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for i, choice in islice(enumerate(combinations(masks, agree)), first, None if most is None else first + most):
        mask = sum(choice)
        keys.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word each, or of a row of words each."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class BKForest:
    """One BK-tree for each run of equal ``tree`` numbers; the first node of a run is its root."""

    def __init__(self, fp: np.ndarray, tree: np.ndarray):
        n = len(fp)
        self.edges = edges = 64 * (fp.shape[1] if fp.ndim == 2 else 1) + 1
        self.levels: list[np.ndarray] = []
        self.fp, self.roots = fp, np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at = self.roots[np.cumsum(np.r_[True, tree[1:] != tree[:-1]]) - 1]
        rest = np.setdiff1d(np.arange(n), self.roots, assume_unique=True)
        while len(rest):
            slot = at[rest] * edges + distance(fp[rest], fp[at[rest]])
            order = np.argsort(slot, kind="stable")
            rest, slot = rest[order], slot[order]
            head = np.r_[True, slot[1:] != slot[:-1]]
            child = rest[head]
            parent[child], edge[child] = slot[head] // edges, slot[head] % edges
            self.levels.append(child)
            down = child[np.cumsum(head) - 1]
            rest = rest[~head]
            at[rest] = down[~head]
        kids = np.flatnonzero(parent >= 0)
        self.parent = parent
        slot = parent[kids] * edges + edge[kids]
        order = np.argsort(slot, kind="stable")
        self.kids, self.slot = kids[order], slot[order]

    def alike(self, label: np.ndarray) -> np.ndarray:
        """Whether all nodes below have the node's own label."""
        same = np.ones(len(self.fp), bool)
        for child in reversed(self.levels):
            up = self.parent[child]
            np.logical_and.at(same, up, same[child] & (label[child] == label[up]))
        return same

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int, label: np.ndarray | None = None, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) of every node within the radius, a bounded number of visits at a time.

        With ``label``, which the caller may merge after each answer, and the nodes' ``rows`` among the queries, branches
        that hold the query's own label alone are left out; a spread few ask first, so that dense groups are soon of one label.
        """
        n, most = len(queries), VISITS // 16
        step = np.arange(n)
        turns = [step] if label is None else [step[step % 64 == 0], step[(step % 8 == 0) & (step % 64 != 0)], step[step % 8 != 0]]
        for turn in turns:
            same = None if label is None else self.alike(label[rows])
            stack = [(turn[a : a + most], roots[turn[a : a + most]]) for a in range(0, len(turn), most)]
            while stack:
                q, v = stack.pop()
                if same is not None:
                    open_ = ~(same[v] & (label[q] == label[rows[v]]))
                    q, v = q[open_], v[open_]
                d = distance(queries[q], self.fp[v])
                hit = d <= radius
                if hit.any():
                    yield q[hit], v[hit]
                low = np.searchsorted(self.slot, v * self.edges + np.maximum(d - radius, 0))
                many = np.searchsorted(self.slot, v * self.edges + np.minimum(d + radius, self.edges - 1), "right") - low
                ends = np.cumsum(many)
                for a, b in _pieces(ends):
                    m = many[a:b]
                    first = np.repeat(low[a:b] - (ends[a:b] - m) + (ends[a - 1] if a else 0), m)
                    if len(first):
                        stack.append((np.repeat(q[a:b], m), self.kids[first + np.arange(len(first))]))


def _pieces(ends: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0]
    while cuts[-1] < len(ends):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + VISITS, "right"))))
    return list(zip(cuts, cuts[1:]))


def join_sets(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite a[i] and b[i]; ``label`` holds each node's smallest known member and is compressed in place."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            return
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _link(radius: int, wide_bits: int | None):
    """Rows come sorted by block, tree shard, role (0: in the tree, 1: visits only) and id.

    With ``wide_bits`` the trees are over the wide fingerprints, and links must be within the radius too.
    """

    def stars(key, role, fp, ids, wide=None) -> pa.RecordBatch | None:
        tree_row = np.flatnonzero(role == 0)
        if not len(tree_row):
            return None
        prints, reach = (fp, radius) if wide is None else (wide, wide_bits)
        forest = BKForest(prints[tree_row], key[tree_row])
        root_of = forest.roots[np.searchsorted(key[tree_row][forest.roots], key)]
        label = np.arange(len(fp))
        for q, v in forest.within(prints, root_of, reach, label, tree_row):
            v = tree_row[v]
            if wide is not None:
                near = distance(fp[q], fp[v]) <= radius
                q, v = q[near], v[near]
            join_sets(label, q, v)
        far = np.flatnonzero(label != np.arange(len(fp)))
        far = far[ids[far] != ids[label[far]]]
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, least = 0, 4 * TREE_NODES
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("block", "tree", "role", "fp", "doc_id")]
            if wide_bits is not None:
                cols.append(flat_bytes(batch.column("wide"))[0].reshape(-1, 8 * LANES).view(np.uint64))
            held.append(tuple(cols))
            rows += len(cols[0])
            if rows < least:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield from run([c[:cut] for c in cols])
            held = [tuple(c[cut:] for c in cols)]
            rows = len(held[0][0])
            least = max(4 * TREE_NODES, 2 * rows)  # a long block is put together a few times, not at each batch
        if held and sum(len(h[0]) for h in held):
            yield from run([np.concatenate(c) for c in zip(*held)])

    def run(cols) -> Iterator[pa.RecordBatch]:
        block, tree, role, fp, ids, *wide = cols
        group = np.cumsum(np.r_[True, (block[1:] != block[:-1]) | (tree[1:] != tree[:-1])])
        out = stars(group, role, fp.view(np.uint64), ids, *wide)
        if out is not None and out.num_rows:
            yield out

    return scan


def linked_nodes(
    ws: Workspace, nodes: DataFrame, radius: int = RADIUS, block_nodes: int = BLOCK_NODES, tree_nodes: int = TREE_NODES, wide_bits: int | None = None,
    keys_at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """(a, b): stars of ids that connect all nodes (fp, doc_id) linked within the radius, over all blocks.

    With ``wide_bits`` nodes have a wide fingerprint too, which links must hold within so many bits.  Keys are written
    ``keys_at_once`` a node at a time, and dropped before the next, so the disk that they take doesn't grow with the number of keys.
    """
    also = [] if wide_bits is None else ["wide"]
    pieces, agree = block_scheme(nodes.count(), radius, block_nodes)
    turns = range(0, math.comb(pieces, agree), keys_at_once)
    found = []
    for turn, first in enumerate(turns):
        keys = block_keys(F.col("fp"), pieces, agree, first, keys_at_once)
        keyed = ws.save(nodes.select(F.explode(keys).alias("block"), "fp", "doc_id", *also), "keyed")
        stars = _blocks(ws, keyed, radius, tree_nodes, wide_bits, also)
        if len(turns) > 1:
            stars = ws.save(stars, f"turn-{turn}-{uuid.uuid4().hex}", small=True)
            ws.drop("keyed", "sizes")
        found.append(stars)
    return reduce(DataFrame.union, found)


def _blocks(ws: Workspace, keyed: DataFrame, radius: int, tree_nodes: int, wide_bits: int | None, also: list[str]) -> DataFrame:
    sizes = ws.save(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("size")), "sizes", small=True)
    rows = sizes.agg(F.sum("size")).first()[0] or 0
    large = sizes.where(F.col("size") > tree_nodes).select("block", F.ceil(F.col("size") / tree_nodes).cast("int").alias("trees"))
    alone = sizes.where("size = 1").count() < rows
    if not alone:
        return ws.spark.createDataFrame([], "a long, b long")
    rows = (
        keyed.join(large, "block", "left")  # a few large blocks are broadcast, many are shuffled and skewed ones split
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.coalesce("trees", F.lit(1))).cast("int"))
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.coalesce("trees", F.lit(1)) - 1)))
        .select("block", "tree", (F.col("tree") != F.col("own")).cast("int").alias("role"), "fp", "doc_id", *also)
    )
    return dealt(rows, parallelism(ws.spark), ["block", "tree"], ["block", "tree", "role", "doc_id"]).mapInArrow(_link(radius, wide_bits), "a long, b long")


def _components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block_nodes: int = BLOCK_NODES, tree_nodes: int = TREE_NODES, digests: bool = False) -> DataFrame:
    """The fingerprints with component, the component's smallest fingerprint, and component_id, its smallest doc_id."""
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.save(fingerprints(docs, shingle, digests), "prints")
    nodes = ws.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows")), "nodes", small=True)
    # a node's id is its fingerprint: doc_ids may be null or repeated
    stars = ws.save(linked_nodes(ws, nodes.select("fp", F.col("fp").alias("doc_id")), radius, block_nodes, tree_nodes), "stars")
    ws.drop("keyed", "sizes")
    labels = ws.save(connected_components(ws, stars), "labels", small=True)
    labelled = ws.save(
        nodes.join(labels.withColumnRenamed("component", "_least"), nodes.fp == labels.node, "left")
        .select("fp", F.coalesce("_least", "fp").alias("component"), "least_id", "rows"), "labelled", small=True)
    least = ws.save(labelled.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "least", small=True)
    index = ws.save(skew_safe_lookup(labelled.drop("least_id"), least, ["component"], "nodes").drop("nodes"), "index", small=True)
    return gathered(skew_safe_lookup(prints, index, ["fp"], "rows")).drop("rows")


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links, null if all are null."""
    return _components(docs, **options).select("doc_id", "fp", "component_id")


def similar_groups(docs: DataFrame, similarity: float = 0.8, radius: int = MEET_RADIUS, block_nodes: int = MEET_NODES, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(doc_id, digest, component, component_id) for every row: groups of texts linked by both fingerprints.

    Cases are those of the module; texts without a word are one node.
    """
    ws = Workspace(docs.sparkSession, "similar")
    prints = ws.save(fingerprints(docs, MEET_SHINGLE, True, WIDE_SHINGLE), "prints")
    nodes = prints.groupBy("fp", "wide").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"))
    nodes = ws.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", small=True)
    meeting = ws.save(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("judged")), "meeting", small=True)
    met = ws.save(linked_nodes(ws, meeting.select("fp", F.col("fp").alias("doc_id")), radius, block_nodes, tree_nodes), "met")
    ws.drop("keyed", "sizes")
    suspects = met.select(F.explode(F.array("a", "b")).alias("fp")).union(meeting.where("judged > 1").select("fp")).distinct()
    judged = ws.save(nodes.join(suspects, "fp", "left_semi").select("fp", "wide", F.col("node").alias("doc_id")), "judged", small=True)
    stars = ws.save(linked_nodes(ws, judged, radius, block_nodes, tree_nodes, wide_radius(similarity)), "stars")
    ws.drop("keyed", "sizes", "met")
    labels = ws.save(connected_components(ws, stars), "labels", small=True)
    labelled = ws.save(
        nodes.join(labels.withColumnRenamed("component", "_least"), "node", "left")
        .select("fp", "wide", F.coalesce("_least", "node").alias("component"), "least_id", "rows"), "labelled", small=True)
    least = ws.save(labelled.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "least", small=True)
    index = ws.save(skew_safe_lookup(labelled.drop("least_id"), least, ["component"], "nodes").drop("nodes"), "index", small=True)
    return gathered(skew_safe_lookup(prints, index, ["fp", "wide"], "rows")).drop("rows")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: the smallest doc_id and, under that, the smallest digest of the text."""
    return _first_of_each(docs, _components(docs, digests=True, **options))


def keep_similar(docs: DataFrame, similarity: float = 0.8, **options) -> DataFrame:
    """The same for groups of texts of the similarity or more, by ``similar_groups``."""
    return _first_of_each(docs, similar_groups(docs, similarity, **options))


def _first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    ws = Workspace(docs.sparkSession, "near")
    least = groups.where("doc_id <=> component_id").groupBy("component", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    kept = ws.save(
        least.groupBy("component").agg(F.min(F.struct("digest", "doc_id", "rows")).alias("one"))
        .select(F.col("one.doc_id").alias("_near_id"), F.col("one.digest").alias("_near_digest"), F.col("one.rows").alias("_near_rows")), "kept", small=True)
    left = docs.withColumn("_near_text", _text_digest()).join(
        kept.drop("_near_rows"), F.col("doc_id").eqNullSafe(F.col("_near_id")) & F.col("_near_text").eqNullSafe(F.col("_near_digest")), "left_semi")
    left = gathered(left)
    return (left if kept.where("_near_rows > 1").isEmpty() else left.dropDuplicates(["doc_id", "_near_text"])).drop("_near_text")
