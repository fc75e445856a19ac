"""Unit vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def norm(vector: Column) -> Column:
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(total)


def l2_normalize(vector: Column) -> Column:
    """Vector over its length; a zero vector stays as it is."""
    length = F.coalesce(F.nullif(norm(vector), F.lit(0.0)), F.lit(1.0))
    return F.transform(vector, lambda x: x.cast("double") / length)


def query_vector(vector: Column) -> Column:
    """As ``l2_normalize``, but a zero vector raises: it cannot be compared with anything."""
    zero = F.raise_error(F.lit("query vector has zero length")).cast("array<double>")
    return F.when(norm(vector) == 0, zero).otherwise(l2_normalize(vector))
