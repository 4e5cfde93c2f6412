"""Arithmetic on array<double> columns, in element order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, added left to right."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector with length 1; an empty or zero vector is an error."""
    length = norm(v)
    # a repeated number: inside a lambda the length would be computed for each element
    return F.when(length > 0, F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n)).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Strict cosine: an empty or zero vector is an error."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("double"))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector is null, empty or zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def confidence(cos: Column) -> Column:
    """A cosine mapped from [-1, 1] to [0, 1]."""
    return F.least(F.greatest((cos + 1) / 2, F.lit(0.0)), F.lit(1.0))


def centroid(df: DataFrame, vector: str) -> DataFrame:
    """One row (centroid): the unit vector along the sum of all unit vectors.

    An empty table, a zero vector or vectors of several widths are errors, raised when the row is computed.
    """
    spread = df.select(F.posexplode(unit(F.col(vector))).alias("i", "x"), F.size(vector).alias("width"))
    sums = spread.groupBy("i").agg(F.sum("x").alias("x"), F.min("width").alias("low"), F.max("width").alias("high"))
    row = sums.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
    ragged = F.raise_error(F.lit("vectors of one width, and at least one, are needed")).cast("array<double>")
    summed = F.transform("parts", lambda p: p["x"])
    return row.select(F.when(F.col("low") == F.col("high"), unit(summed)).otherwise(ragged).alias("centroid"))
