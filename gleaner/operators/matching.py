"""Matching items against reference vectors: scores, statistics and the references' own consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import centroid, confidence, cosine

#: Lowest confidence between two references of one subject; most references that help.
CONSISTENT, MANY_REFERENCES = 0.65, 5


def scored(items: DataFrame, references: DataFrame, vector: str = "vec") -> DataFrame:
    """``match``: confidence of each item's vector against the references' centroid, one row that is broadcast; 6 places."""
    target = F.broadcast(centroid(references, vector))
    return items.join(target).withColumn("match", F.round(confidence(cosine(F.col(vector), F.col("centroid"))), 6)).drop("centroid")


def statistics(items: DataFrame, threshold: float) -> DataFrame:
    """One row over items with a subject: counts, exact median and five fixed buckets."""
    s = F.col("match")
    edges = (0.5, 0.6, 0.7, 0.8)
    names = ("below_50", "from_50", "from_60", "from_70", "from_80")
    tests = [s < 0.5, *[(s >= a) & (s < b) for a, b in zip(edges, edges[1:])], s >= 0.8]
    return items.where("subjects > 0 and match is not null").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(s >= threshold).alias("passed"), F.round(F.min(s), 6).alias("minimum"), F.round(F.median(s), 6).alias("median"),
        F.round(F.max(s), 6).alias("maximum"), *[F.count_if(t).alias(n) for t, n in zip(tests, names)])


def reference_pairs(references: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """(left_ref, right_ref, score) of all pairs of references, a handful by their nature."""
    a = references.select(F.col(key).alias("left_ref"), F.col(vector).alias("a"))
    b = references.select(F.col(key).alias("right_ref"), F.col(vector).alias("b"))
    return a.join(F.broadcast(b), F.col("left_ref") < F.col("right_ref")).select("left_ref", "right_ref", F.round(confidence(cosine(F.col("a"), F.col("b"))), 6).alias("score"))


def reference_summary(references: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """One row: counts, lowest and mean score, the lowest pair, and the first warning that applies."""
    pairs = reference_pairs(references, key, vector).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("score").alias("lowest"), F.round(F.avg("score"), 6).alias("average"), F.min_by(F.struct("left_ref", "right_ref"), F.struct("score", "left_ref", "right_ref")).alias("pair"))
    both = references.agg(F.count(F.lit(1)).alias("refs")).join(F.broadcast(pairs))  # one row each
    warning = F.when(F.col("refs") == 1, "few_references").when(F.col("lowest") < CONSISTENT, "inconsistent").when(F.col("refs") > MANY_REFERENCES, "many_references")
    return both.select("refs", "pairs", "lowest", "average", F.col("pair.left_ref").alias("lowest_left"), F.col("pair.right_ref").alias("lowest_right"), warning.alias("warning"))


def single_subject(references: DataFrame) -> DataFrame:
    """The references; one that doesn't show exactly one subject is an error."""
    return references.withColumn("subjects", F.when(F.col("subjects") == 1, F.col("subjects")).otherwise(F.raise_error(F.lit("a reference must show one subject")).cast("int")))


def largest_subject(boxes):
    """The box (left, top, right, bottom) with the largest area of an array of boxes."""
    sized = F.transform(boxes, lambda b: F.struct(((b[2] - b[0]) * (b[3] - b[1])).alias("area"), b.alias("box")))
    return F.array_max(sized)["box"]
