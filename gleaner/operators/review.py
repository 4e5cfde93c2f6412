"""Review of decided items: filters, explanations and manual edits that choose anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Choice
from .selection import select

#: Items that may be put in by hand: the chosen ones, those left over, and those taken out by hand.
ADMISSIBLE = (None, "REDUNDANT", "MANUAL")


def filtered(items: DataFrame, view: str = "all", minimum_match: float = 0.0, minimum_quality: float = 0.0) -> DataFrame:
    """Items of a view (selected, rejected or a reason code; any other name means all) with both minimums, in review order."""
    views = {"selected": F.col("decision") == "selected", "rejected": F.col("decision") == "rejected"}
    for code in ("INVALID", "MULTI_SUBJECT", "LOW_MATCH", "LOW_QUALITY", "DUPLICATE", "REDUNDANT", "MANUAL"):
        views[code] = F.col("reason_code") == code
    rows = items.where(views[view]) if view in views else items
    # nothing measured counts as 0, so a minimum of 0 passes every item
    rows = rows.where((F.coalesce("match", F.lit(0.0)) >= minimum_match) & (F.coalesce("quality", F.lit(0.0)) >= minimum_quality))
    return rows.orderBy(F.when(F.col("decision") == "selected", 0).otherwise(1), F.col("reason_code").asc_nulls_first(), F.col("value").desc_nulls_last(), "path")


def explained(items: DataFrame) -> DataFrame:
    """``why``: the reasons joined, or the reason code in plain words where there are none."""
    return items.withColumn("why", F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lower(F.replace(F.coalesce("reason_code", "decision"), F.lit("_"), F.lit(" ")))))


def edited(items: DataFrame, choice: Choice, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Every item decided anew after an edit, with was (its decision before) and note.

    note: EXCLUDED for the item taken out by hand, DISPLACED for one that the new choice leaves out, INCLUDED for the one put
    in, else null.

    ``items``: the candidates' columns, decision, reason_code and forced.  Gates and duplicates stay as they are.
    """
    named = {r.path: r for r in items.where(F.col("path").isin(*[x for x in (include, exclude) if x] or [""])).select("path", "decision", "reason_code").collect()}
    if include is not None and include == exclude:
        raise ValueError("two different items are needed")
    if include is not None and (include not in named or named[include].reason_code not in ADMISSIBLE):
        raise ValueError("this item can't be put in")
    if exclude is not None and (exclude not in named or named[exclude].decision != "selected"):
        raise ValueError("only a selected item can be taken out")
    forced_before = [r.path for r in items.where("forced and decision = 'selected'").select("path").orderBy("path").limit(choice.count).collect()]
    forced = sorted({*forced_before, *([include] if include else [])} - {exclude})
    pool = items.where((F.col("decision") == "selected") | (F.col("reason_code") == "REDUNDANT") | (F.col("path") == F.lit(include or "")))
    pool = pool.where(F.col("path") != F.lit(exclude or ""))
    picks = select(pool, choice, forced).select("path", "pick", F.col("value").alias("new_value"))
    rows = items.drop("pick").withColumn("was", F.col("decision")).join(picks, "path", "left")
    code = (
        F.when(F.col("pick").isNotNull(), F.lit(None).cast("string")).when(F.col("path") == F.lit(exclude or ""), "MANUAL")
        .when(F.col("was") == "selected", "REDUNDANT").otherwise(F.col("reason_code")))
    gone = F.col("pick").isNull() & (F.col("was") == "selected")
    note = F.when(F.col("path") == F.lit(exclude or ""), "EXCLUDED").when(gone, "DISPLACED").when(F.col("pick").isNotNull() & (F.col("path") == F.lit(include or "")), "INCLUDED")
    return (
        rows.withColumns({"reason_code": code, "note": note}).withColumn("decision", F.when(F.col("pick").isNotNull(), "selected").otherwise("rejected"))
        .withColumn("value", F.col("new_value")).withColumn("forced", F.col("path").isin(*forced) if forced else F.lit(False)).drop("pick", "new_value"))


def difference(items: DataFrame) -> DataFrame:
    """(path, change) of edited items: added to or removed from the chosen."""
    return items.where("was <> decision").select("path", F.when(F.col("decision") == "selected", "added").otherwise("removed").alias("change"))
