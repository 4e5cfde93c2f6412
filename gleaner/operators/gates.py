"""Ordered gates: the first that an item fails is its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import Limits


def reason(limits: Limits) -> Column:
    """The reason code of the first failed gate, null if all pass; a value equal to its limit passes."""
    invalid = F.coalesce("invalid", F.lit(False)) | (F.coalesce("subjects", F.lit(0)) == 0)
    several = (F.col("subjects") > 1) & F.lit(limits.alone)
    return (
        F.when(invalid, "INVALID").when(several, "MULTI_SUBJECT")
        .when(F.coalesce("match", F.lit(0.0)) < limits.match, "LOW_MATCH").when(F.coalesce("quality", F.lit(0.0)) < limits.quality, "LOW_QUALITY"))


def gated(items: DataFrame, limits: Limits) -> DataFrame:
    return items.withColumn("reason_code", reason(limits))
