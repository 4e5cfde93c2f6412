"""Exact and near duplicates.

Near duplicates are found in priority order (quality descending, path ascending): an item joins the earliest
*representative* within the radius, or becomes a representative.  Items with one hash are one node, as all that is compared
is the hash: the first of them decides for all.  The rest is the lexicographically first maximal
independent set of the within-radius graph, found in a few parallel rounds (Blelloch, Fineman and Shun, SPAA 2012).
Candidates come from an exact index of pieces of the hash: hashes within r bits agree on some choice of k among
r + k pieces, and k follows the number of hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import agreed, hamming, packed, piece_keys, piece_scheme, unpacked
from ..sources.store import Tables


def by_shuffle(rows: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, however small Spark takes it to be.

    Its guess is the size of packed files, and for keys made by a generator that of the rows they are made from; the real
    size may be a hundred times that, and the driver would have to hold it.
    """
    return rows.hint("merge")


def exact(items: DataFrame) -> DataFrame:
    """(path, fingerprint, keep_path, copies): of equal fingerprints the best by quality, then path, stays."""
    best = items.groupBy("fingerprint").agg(F.min(F.struct((-F.col("quality")).alias("q"), "path")).alias("b"), F.count(F.lit(1)).alias("copies"))
    return items.select("path", "fingerprint").join(best.select("fingerprint", F.col("b.path").alias("keep_path"), "copies"), "fingerprint")


def close_hashes(hashes: DataFrame, radius: int) -> DataFrame:
    """(a, b) with a < b of distinct hashes within the radius; ``hashes``: (hash), distinct, none empty, cheap to read twice.

    A pair is given once, where its first choice of agreeing pieces meets, so nothing has to be made distinct afterwards.
    """
    pieces, agree = piece_scheme(hashes.count(), radius)
    keyed = hashes.select(packed(F.col("hash")).alias("h")).select("h", F.inline(piece_keys(F.col("h"), pieces, agree)))
    left, right = keyed.select("pick", "part", "below", F.col("h").alias("x")), keyed.select("pick", "part", F.col("h").alias("y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = agreed(differ, pieces).bitwiseAND(F.col("below")) == F.col("pick")
    pairs = left.join(by_shuffle(right), ["pick", "part"]).where("x < y").where(F.bit_count(differ) <= radius).where(first)
    x, y = unpacked(F.col("x")), unpacked(F.col("y"))
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def hash_classes(items: DataFrame, key: str) -> DataFrame:
    """(key, hash, class_id) of items (key, hash) with a hash: items with one hash are a class, named by the smallest key."""
    filled = items.where("hash <> ''").select(key, "hash")
    return filled.join(filled.groupBy("hash").agg(F.min(key).alias("class_id")), "hash").select(key, "hash", "class_id")


def hamming_pairs(items: DataFrame, key: str, radius: int) -> DataFrame:
    """(left_id, right_id, distance) of all classes of ``hash_classes`` within the radius; copies aren't expanded into pairs."""
    tables = Tables(items.sparkSession, "pairs")
    heads = tables.save(items.where("hash <> ''").groupBy("hash").agg(F.min(key).alias("id")), "heads")
    close = tables.save(close_hashes(heads.select("hash"), radius), "close")  # its size is known only when it is written
    side = lambda h, k: by_shuffle(heads.select(F.col("hash").alias(h), F.col("id").alias(k)))
    both = close.join(side("a", "p"), "a").join(side("b", "q"), "b")
    return both.select(F.least("p", "q").alias("left_id"), F.greatest("p", "q").alias("right_id"), hamming(F.col("a"), F.col("b")).alias("distance"))


def near(items: DataFrame, radius: int | None) -> DataFrame:
    """(path, duplicate_of, group_id) for every item (path, fingerprint, hash, quality); see ``judged``."""
    return judged(items, radius).select("path", "duplicate_of", "group_id")


def judged(items: DataFrame, radius: int | None) -> DataFrame:
    """(path, quality, duplicate_of, group_id) for every item (path, fingerprint, hash, quality), which is computed once.

    duplicate_of: the representative's path, null for representatives; group_id: its fingerprint, null where
    nothing joined.  An empty or null hash, or no radius, matches exactly only.
    """
    tables = Tables(items.sparkSession, "near")
    order = F.struct((-F.col("quality")).alias("q"), F.col("path").alias("p"))
    ranked = tables.save(items.select("path", "fingerprint", F.coalesce("hash", F.lit("")).alias("hash"), order.alias("rank")), "items")
    # equal bytes have equal hashes and quality, so copies follow their first
    nodes = tables.save(ranked.groupBy("fingerprint").agg(F.min("rank").alias("rank"), F.min_by("hash", "rank").alias("hash"), F.count(F.lit(1)).alias("rows")), "nodes")
    heads = nodes.select(F.col("fingerprint").alias("rep"), F.col("rank.p").alias("rep_path"))
    if radius is None:
        owner = nodes.select("fingerprint", "rows", F.col("fingerprint").alias("rep"))
    else:
        classes = tables.save(nodes.where("hash <> ''").groupBy("hash").agg(F.min("rank").alias("rank"), F.min_by("fingerprint", "rank").alias("head")), "classes")
        lead = classes.join(by_shuffle(_representatives(tables, classes, radius)), "hash", "left").select("hash", F.coalesce("lead", "hash").alias("lead"))
        led = lead.join(by_shuffle(classes.select(F.col("hash").alias("lead"), F.col("head").alias("rep"))), "lead").select("hash", "rep")
        owner = nodes.join(by_shuffle(led), "hash", "left").select("fingerprint", "rows", F.coalesce("rep", "fingerprint").alias("rep"))
    owner = tables.save(owner, "owner")
    sizes = owner.groupBy("rep").agg(F.sum("rows").alias("size"))
    placed = ranked.join(by_shuffle(owner.select("fingerprint", "rep")), "fingerprint").join(by_shuffle(heads.join(by_shuffle(sizes), "rep")), "rep")
    duplicate_of, group = F.when(F.col("path") != F.col("rep_path"), F.col("rep_path")), F.when(F.col("size") > 1, F.col("rep"))
    return placed.select("path", (-F.col("rank.q")).alias("quality"), duplicate_of.alias("duplicate_of"), group.alias("group_id"))


def _representatives(tables: Tables, classes: DataFrame, radius: int) -> DataFrame:
    """(hash, lead): for each hash that is no representative's the hash of its representative; ``classes``: hash, rank."""
    pairs = tables.save(close_hashes(classes.select("hash"), radius), "close")
    side = lambda n: by_shuffle(classes.select(F.col("hash").alias("ab"[n]), F.col("rank").alias(f"rank_{'ab'[n]}")))
    ranked = pairs.join(side(0), "a").join(side(1), "b")
    earlier = F.col("rank_a") < F.col("rank_b")
    pick = lambda x, y: F.when(earlier, F.col(x)).otherwise(F.col(y))
    edges = tables.save(ranked.select(pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("rank_a", "rank_b").alias("u_rank")), "edges")
    open_, out, step = edges.select("u", "v"), None, 0
    while not open_.isEmpty():
        heads = by_shuffle(open_.select("u").distinct().join(by_shuffle(open_.select(F.col("v").alias("u")).distinct()), "u", "left_anti"))
        gone = tables.save(open_.join(heads, "u").select("v").distinct(), f"gone-{step}")
        out = gone if out is None else out.union(gone)
        left = open_.join(heads, "u", "left_anti").join(by_shuffle(gone.select(F.col("v").alias("u"))), "u", "left_anti").join(by_shuffle(gone), "v", "left_anti")
        open_ = tables.save(left.select("u", "v"), f"open-{step}")
        step += 1
    if out is None:
        return classes.select("hash", F.col("hash").alias("lead")).limit(0)
    heads = edges.join(by_shuffle(out.select(F.col("v").alias("u"))), "u", "left_anti")
    return heads.join(by_shuffle(out), "v").groupBy(F.col("v").alias("hash")).agg(F.min_by("u", "u_rank").alias("lead"))


def peers(items: DataFrame, path: str) -> DataFrame:
    """Other items of an item's duplicate group: selected first, then quality descending, then path."""
    own = items.where(F.col("path") == path).agg(F.min("duplicate_group")).first()[0]  # one row reaches the driver; nothing is joined or broadcast
    found = items.where(F.col("duplicate_group") == F.lit(own)).where(F.col("path") != path)
    return found.orderBy(F.when(F.col("category") == "selected", 0).otherwise(1), F.desc("quality"), "path")
