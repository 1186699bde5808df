"""Range and radius joins of points with query centres, in one to three dimensions.

points: point_id and x, y, z; queries: query_id and qx, qy, qz. Dimensions are named by axes. Boxes are closed,
their sides computed as centre -+ half-width; spheres are open unless closed is set. A negative half-width or
radius matches nothing. Results are sets; every query has a row in the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweave.functions.exprs import AXES
from geoweave.operators.boxes import numbered, overlap_join, point_boxes


def _query_boxes(queries: DataFrame, half, axes) -> DataFrame:
    sides = dict.fromkeys(axes, half) if not isinstance(half, dict) else half
    as_sql = {a: h if isinstance(h, str) else f"CAST({h!r} AS DOUBLE)" for a, h in sides.items()}
    return queries.selectExpr("*", *(f"q{a} - {as_sql[a]} AS min{a}" for a in axes), *(f"q{a} + {as_sql[a]} AS max{a}" for a in axes))


def box_report(points: DataFrame, queries: DataFrame, half, axes=AXES) -> DataFrame:
    """(query_id, point_id) of points in the box around a query. half: a number, a column's name, or those by axis."""
    slim = points.select("point_id", *axes)
    met = overlap_join(_query_boxes(queries.select("query_id", *(f"q{a}" for a in axes), *_named(queries, half)), half, axes), point_boxes(slim, axes), axes, alike=("query_id", "point_id"))
    return met.select(F.col("l_query_id").alias("query_id"), F.col("r_point_id").alias("point_id"))


def _named(queries: DataFrame, half) -> list[str]:
    used = [h for h in (half.values() if isinstance(half, dict) else [half]) if isinstance(h, str)]
    return [c for c in dict.fromkeys(used) if c in queries.columns]


def sphere_report(points: DataFrame, queries: DataFrame, radius, axes=AXES, closed: bool = False) -> DataFrame:
    """(query_id, point_id, d2) of points within the radius of a query."""
    slim = points.select("point_id", *axes)
    r = radius if isinstance(radius, str) else f"CAST({radius!r} AS DOUBLE)"
    boxes = _query_boxes(queries.select("query_id", *(f"q{a}" for a in axes), *_named(queries, radius)), radius, axes).withColumn("r", F.expr(r))
    d2 = " + ".join(f"(r_{a} - l_q{a}) * (r_{a} - l_q{a})" for a in axes)
    met = overlap_join(boxes, point_boxes(slim, axes), axes, f"l_r >= 0e0 AND ({d2}) {'<=' if closed else '<'} l_r * l_r", alike=("query_id", "point_id"))
    return met.select(F.col("l_query_id").alias("query_id"), F.col("r_point_id").alias("point_id"), F.expr(d2).alias("d2"))


def counts(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, n) of every query, those without a match included."""
    n = pairs.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _places(queries: DataFrame, half, axes) -> tuple[DataFrame, DataFrame]:
    """What queries ask, each once with a number as query_id; and (_kind, query_id): the number that a query's is."""
    every, kinds = numbered(queries, [*(f"q{a}" for a in axes), *_named(queries, half)], "query_id")
    return every, kinds.withColumnRenamed("_kind", "query_id")


def _of_each(every: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return every.join(found.withColumnRenamed("query_id", "_kind").hint("merge"), "_kind", how).drop("_kind")


def box_counts(points: DataFrame, queries: DataFrame, half, axes=AXES) -> DataFrame:
    """counts of a box_report; queries at one place are counted once, and no pair is written out for each."""
    every, places = _places(queries, half, axes)
    n = box_report(points, places, half, axes).groupBy("query_id").agg(F.count("*").alias("n"))
    return _of_each(every, n, "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def within(points: DataFrame, queries: DataFrame, radius, axes=AXES, closed: bool = False, some: bool = True) -> DataFrame:
    """(query_id) of queries that have a point within the radius, or, unless some, that have none; each place is asked
    once."""
    every, places = _places(queries, radius, axes)
    near = sphere_report(points, places, radius, axes, closed).select("query_id").distinct()
    return _of_each(every, near, "left_semi" if some else "left_anti")


def without(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Queries that no pair has."""
    return queries.join(pairs.select("query_id").distinct(), "query_id", "left_anti")


def having(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    return queries.join(pairs.select("query_id").distinct(), "query_id", "left_semi")


def knn(points: DataFrame, queries: DataFrame, k: int, axes=AXES) -> DataFrame:
    """(query_id, rank, point_id, d2): the k nearest points, ties to the smaller id. Each query looks within a bound of
    the distance to its k-th neighbour, so one radius join finds them all; queries at one place look once."""
    from geoweave.operators.nearest import reaches

    every, places = _places(queries, None, axes)
    asked = places.selectExpr("query_id", *(f"q{a} AS {a}" for a in axes))
    held = reaches(asked, points.select(*axes), k, "query_id", axes).selectExpr("query_id", *(f"{a} AS q{a}" for a in axes), "sqrt(u) * 1.000000000001D + 1e-300 AS r")
    near = sphere_report(points, held, "r", axes, closed=True)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d2", "point_id"))
    found = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "d2")
    return _of_each(every, found, "inner").select("query_id", "rank", "point_id", "d2")
