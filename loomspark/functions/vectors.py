"""Arithmetic on array<double> columns, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _fold(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_fold(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a, b) -> Column:
    return F.sqrt(_fold(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a, b) -> Column:
    """Over the shorter length; 0 where a vector is zero."""
    n = F.least(F.size(_col(a)), F.size(_col(b)))
    x, y = F.slice(_col(a), F.lit(1), n), F.slice(_col(b), F.lit(1), n)
    d = norm(x) * norm(y)
    return F.when(d == 0, 0.0).otherwise(dot(x, y) / F.nullif(d, F.lit(0.0)))


def sigmoid(x) -> Column:
    x = _col(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
