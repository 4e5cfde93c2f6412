"""Progress of runs from their events: rates, time left and a smoothed rate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weight of a new value in the smoothed rate.
ALPHA = 0.25
#: Most values of a run that are kept; up to this many Spark keeps the last ones before it shuffles.
LASTING = 1000


def rate(done: Column, elapsed: Column) -> Column:
    """Items a second; time counts as a millisecond at least."""
    return done / F.greatest(elapsed, F.lit(0.001))


def time_left(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the present rate, null before the first item."""
    r = rate(done, elapsed)
    return F.when(r > 0, (total - done) / r)


def smoothed(values: Column, alpha: float = ALPHA) -> Column:
    """Exponentially weighted mean over an ordered array; the first value starts it."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))


def smoothed_rates(events: DataFrame, run: str, order: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """(run, smoothed): over each run's values in order, equal places by value; null values are passed over.

    The n-th last value weighs alpha * (1 - alpha)**(n - 1) and the first of all (1 - alpha)**(n - 1), so only the last LASTING
    values can change a double: tasks keep these before the shuffle, and a run of any length is a few rows.
    """
    lasting = min(LASTING, math.ceil(-92 / math.log(1 - alpha)))  # by then a weight is under 1e-40
    rows = events.where(F.col(value).isNotNull()).select(F.col(run).alias("run"), F.col(order).alias("place"), F.col(value).cast("double").alias("x"))
    last = rows.withColumn("n", F.row_number().over(W.partitionBy("run").orderBy(F.desc("place"), F.desc("x")))).where(F.col("n") <= lasting)
    totals = rows.groupBy("run").agg(F.count(F.lit(1)).alias("total"))
    weight = F.pow(F.lit(1 - alpha), F.col("n") - 1) * F.when(F.col("n") == F.col("total"), 1.0).otherwise(alpha)
    known = last.join(totals.withColumnRenamed("run", "of"), F.col("run").eqNullSafe(F.col("of")))
    return known.groupBy("run").agg(F.sum(weight * F.col("x")).alias("smoothed")).select(F.col("run").alias(run), "smoothed")
