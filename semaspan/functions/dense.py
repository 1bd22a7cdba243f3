"""Measures on dense vectors held as arrays of the same length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE_FLOOR = 1e-8  # fixed value: smallest denominator of the cosine


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, floor: float = COSINE_FLOOR) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))
