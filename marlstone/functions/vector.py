"""Vector expressions over array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for null or zero vectors, and for NaN components."""
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(~F.isnan(value), value)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def unit_vectors(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` with the vectors of ``col`` at length 1, so that a pair costs one product; null for
    null and zero vectors and for NaN or infinite components."""
    length = norm(F.col(col))
    ok = (length > 0) & ~F.isnan(length) & (length < float("inf"))
    with_length = rows.withColumn("_length", F.when(ok, length))
    scaled = F.when(F.col("_length").isNotNull(), F.transform(col, lambda x: x.cast("double") / F.col("_length")))
    return with_length.withColumn(col, scaled).drop("_length")


def only_unit_vectors(rows: DataFrame, col: str) -> DataFrame:
    """``unit_vectors`` of the rows that have one. The lengths are tested and not the vectors made: a test of these
    would be moved below them and find the length again for each of their numbers."""
    length = norm(F.col(col))
    return unit_vectors(rows.where((length > 0) & ~F.isnan(length) & (length < float("inf"))), col)
