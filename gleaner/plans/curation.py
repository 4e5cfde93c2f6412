"""The whole flow: match, gate, drop duplicates, cluster and choose; every item ends decided, with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import coarse_pose, first_filled
from ..operators import clusters, duplicates, gates, matching, selection
from ..sources.store import Tables
from .policy import Policy


def candidates(items: DataFrame) -> DataFrame:
    """Columns that the choice needs; pose falls back to the coarse direction, the vector to the match vector."""
    pose = F.when(F.coalesce("pose", F.lit("")) != "", F.col("pose")).otherwise(coarse_pose(F.col("yaw")))
    return items.withColumn("pose", pose).withColumn("vec", first_filled(F.col("visual_vec"), F.col("vec")))


def curate(items: DataFrame, references: DataFrame, policy: Policy) -> DataFrame:
    """Every item with match, clusters, duplicate_group, decision, reason_code, pick and value.

    ``items``: collection, path, fingerprint, hash, subjects, invalid, quality, yaw, pitch, expression, vec, scene_vec and
    appearance_vec.  ``references``: vec.
    """
    tables = Tables(items.sparkSession, "curate")
    gated = tables.save(gates.gated(matching.scored(items, references), policy.limits), "gated")  # features are computed once
    passed = gated.where("reason_code is null")
    groups = tables.save(duplicates.near(passed, policy.near_bits), "groups")
    joined = gated.join(groups, "path", "left").withColumnRenamed("group_id", "duplicate_group")
    joined = joined.withColumn("reason_code", F.coalesce("reason_code", F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE")))
    clustered = tables.save(clusters.clustered(joined), "clustered")
    picks = tables.save(selection.select(candidates(clustered.where("reason_code is null")), policy.choice), "picks")
    return selection.decided(clustered, picks)


def reasons(items: DataFrame) -> DataFrame:
    """``reasons``: an array of sentences for each decided item; one whose decision an edit changed has its own."""
    note = F.col("note") if "note" in items.columns else F.lit(None).cast("string")
    text = (
        F.when(note == "DISPLACED", "left the set when it was chosen anew after an edit by hand")
        .when(note == "EXCLUDED", "taken out by hand")
        .when(F.col("decision") == "selected", F.concat(F.lit("pick "), F.col("pick").cast("string"), F.lit(", value "), F.format_number("value", 3)))
        .when(F.col("reason_code") == "DUPLICATE", F.concat(F.lit("copy of "), F.col("duplicate_of")))
        .when(F.col("reason_code") == "LOW_MATCH", F.concat(F.lit("match "), F.format_number("match", 3)))
        .when(F.col("reason_code") == "LOW_QUALITY", F.concat(F.lit("quality "), F.format_number("quality", 3)))
        .otherwise(F.lower(F.replace("reason_code", F.lit("_"), F.lit(" ")))))
    return items.withColumn("reasons", F.array(text))
