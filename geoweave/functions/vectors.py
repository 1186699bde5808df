"""Vectors of any length as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def plus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def negated(a) -> Column:
    return F.transform(a, lambda x: -x)


def scaled(a, by) -> Column:
    return F.transform(a, lambda x: x * by)


def divided(a, by) -> Column:
    return F.transform(a, lambda x: x / F.nullif(by if isinstance(by, Column) else F.lit(by), F.lit(0.0)))


def prod(a) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def sq_length(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def sq_distance(a, b) -> Column:
    return sq_length(minus(a, b))
