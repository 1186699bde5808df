"""Distance fields on a grid: unsigned, signed by parity, or the sign alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweave.operators.grids import Grid
from geoweave.operators.nearest import nearest_facet
from geoweave.operators.rays import hits


def flips(tri: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, k, n): how many spans between consecutive hits (1, 2), (3, 4), ... hold the voxel."""
    w = W.partitionBy("i", "j").orderBy("z")
    pairs = hits(tri, grid, signed=False).withColumns({"rn": F.row_number().over(w), "z2": F.lead("z").over(w)}).where("rn % 2 = 1 AND z2 IS NOT NULL")
    at = lambda z: f"CAST(round(({z} - {grid.oz!r}D) / {grid.h!r}D) AS INT)"  # noqa: E731  halves away from zero
    run = pairs.selectExpr("i", "j", f"greatest({at('z')}, 0) AS lo", f"least({at('z2')}, {grid.nz}) - 1 AS hi").where("lo <= hi")
    return run.selectExpr("i", "j", "explode(sequence(lo, hi)) AS k").groupBy("i", "j", "k").agg(F.count("*").alias("n"))


def unsigned(tri: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, k, value): distance of each voxel's centre to the nearest facet, as float."""
    cells = grid.cells(tri.sparkSession)
    points = cells.selectExpr(f"(CAST(k AS BIGINT) * {grid.ny} + j) * {grid.nx} + i AS point_id", *(f"{grid.centre(a, v)} AS {a}" for a, v in zip("xyz", "ijk", strict=True)))
    d = nearest_facet(points, tri)
    return d.selectExpr(f"CAST(point_id % {grid.nx} AS INT) AS i", f"CAST((point_id DIV {grid.nx}) % {grid.ny} AS INT) AS j", f"CAST(point_id DIV {grid.nx * grid.ny} AS INT) AS k", "CAST(sqrt(d2) AS FLOAT) AS value")


def signed(field: DataFrame, tri: DataFrame, grid: Grid) -> DataFrame:
    """The field with its sign changed once for each span that holds the voxel: negative inside."""
    odd = flips(tri, grid).where("n % 2 = 1").withColumn("flip", F.lit(True)).drop("n")
    return field.join(odd, ["i", "j", "k"], "left").selectExpr("i", "j", "k", "CASE WHEN flip THEN -value ELSE value END AS value")


def signs(tri: DataFrame, grid: Grid) -> DataFrame:
    """A field of 1, -1 inside."""
    return signed(grid.cells(tri.sparkSession).withColumn("value", F.lit(1.0).cast("float")), tri, grid)
