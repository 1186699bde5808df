"""Seeded numbers as SQL: a hash of columns, so every run and every task draws the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweave.functions.exprs import AXES


def uniform(*parts) -> str:
    """A double in [0, 1) from whole numbers, columns and literals: 52 bits of the MD5 of them as text, which other
    databases can make too."""
    text = f"concat_ws(':', {', '.join(map(str, parts))})"
    return f"(CAST(conv(substring(md5(CAST({text} AS BINARY)), 1, 13), 16, 10) AS DOUBLE) / 4503599627370496e0)"


def uniform_real(low: float, high: float, *parts) -> str:
    return f"({low!r}D + {high - low!r}D * {uniform(*parts)})"


def uniform_int(low: int, high: int, *parts) -> str:
    """Both ends included."""
    return f"(CAST({low} AS BIGINT) + CAST(floor({uniform(*parts)} * {high - low + 1}) AS BIGINT))"


def points(spark: SparkSession, n: int, low: float = 0.0, high: float = 100.0, seed: int = 1, axes=AXES) -> DataFrame:
    """(point_id, axes): n points, uniform in a cube."""
    return spark.range(n).selectExpr("id AS point_id", *(f"{uniform_real(low, high, 'id', seed, k)} AS {a}" for k, a in enumerate(axes)))
