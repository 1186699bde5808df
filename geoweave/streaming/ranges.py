"""Range joins of a stream of points with a static table of query boxes.

The points' side needs no look at its rows: a point enters the grids of the boxes' levels, which come from the
static side. The join is stream-static, so it has no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions.exprs import AXES
from geoweave.operators.boxes import entered, least_level, levelled, measured


def box_report(points: DataFrame, boxes: DataFrame, axes=AXES) -> DataFrame:
    """(query_id, point_id, and the points' other columns p_*) of streamed points within static boxes (query_id, minx ...)."""
    static = levelled(boxes.select("query_id", *(f"{m}{a}" for a in axes for m in ("min", "max"))), axes)
    levels, far, *_ = measured(static, axes)
    least = least_level(far)
    held = entered(static.withColumn("_own", F.greatest("_own", F.lit(least))), axes, [], "q_")
    at = ", ".join(str(v) for v in sorted({max(v, least) for v in levels})) or "0"
    moved = points.select(*(F.col(c).alias(f"p_{c}") for c in points.columns)).withColumn("_level", F.expr(f"explode(array({at}))"))
    # a point too far away for a cell number is in no box
    moved = moved.selectExpr("*", *(f"try_cast(floor(p_{a} / power(2e0, _level)) AS BIGINT) AS _c{a}" for a in axes))
    met = moved.join(held.drop("_size"), ["_level", *(f"_c{a}" for a in axes)])
    met = met.where(" AND ".join(f"p_{a} BETWEEN q_min{a} AND q_max{a}" for a in axes))
    return met.select(F.col("q_query_id").alias("query_id"), F.col("p_point_id").alias("point_id"), *(c for c in moved.columns if c.startswith("p_") and c != "p_point_id"))
