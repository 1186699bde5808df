"""Rays along z through the columns of a grid, and what follows: voxels, dexels, fill.

No join is needed: each triangle is exploded to the columns under its box (one more on each side, for rounding)
and the exact test decides. All later steps group by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweave.functions import exprs as E
from geoweave.operators.grids import Grid


def _range(axis: str, g: Grid) -> str:
    o, n = getattr(g, f"o{axis}"), g.size(axis)
    lo = f"greatest(CAST(ceil((least(t0{axis}, t1{axis}, t2{axis}) - {o!r}D) / {g.h!r}D - 5e-1) AS INT) - 1, 0)"
    hi = f"least(CAST(floor((greatest(t0{axis}, t1{axis}, t2{axis}) - {o!r}D) / {g.h!r}D - 5e-1) AS INT) + 1, {n - 1})"
    return f"explode(CASE WHEN {lo} <= {hi} THEN sequence({lo}, {hi}) ELSE CAST(array() AS array<int>) END)"


def hits(tri: DataFrame, grid: Grid, signed: bool = True) -> DataFrame:
    """(i, j, z, sign) where the rays through the columns' centres meet triangles; signed: vertical ones drop out."""
    out = tri.selectExpr("*", f"{_range('x', grid)} AS i").selectExpr("*", f"{_range('y', grid)} AS j")
    out = E.apply(out, [("_px", grid.centre("x", "i")), ("_py", grid.centre("y", "j")), *E.column_hit("_px", "_py")])
    out = out.where("hit AND sign <> 0" if signed else "hit")
    return out.select("i", "j", "z", "sign")


def _first_above(grid: Grid) -> str:
    """First k, clamped to the grid, whose centre is above z: guessed, then decided by the very comparison."""
    k = f"CAST(floor((z - {grid.oz!r}D) / {grid.h!r}D - 5e-1) AS INT) + 1"
    above = lambda e: f"{grid.centre('z', e)} > z"
    return f"greatest(0, least({grid.nz}, CASE WHEN {above(f'({k} - 1)')} THEN {k} - 1 WHEN {above(f'({k})')} THEN {k} ELSE {k} + 1 END))"


def inside_runs(ray_hits: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, lo, hi): runs of voxels lo <= k < hi whose centres the signs below wind around (sum below 0)."""
    steps = ray_hits.selectExpr("i", "j", f"{_first_above(grid)} AS lo", "sign").groupBy("i", "j", "lo").agg(F.sum("sign").alias("s"))
    w = W.partitionBy("i", "j").orderBy("lo")
    run = steps.withColumn("sum", F.sum("s").over(w)).withColumn("hi", F.lead("lo", 1, grid.nz).over(w))
    return run.where("sum < 0 AND lo < hi").select("i", "j", "lo", "hi")


def voxelise(tri: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, k) of the voxels inside."""
    return inside_runs(hits(tri, grid), grid).selectExpr("i", "j", "explode(sequence(lo, hi - 1)) AS k")


def fill_fraction(inside: DataFrame, grid: Grid) -> DataFrame:
    """Per cent of the grid's voxels that are inside."""
    return inside.agg((F.lit(100.0) * F.count("*") / float(grid.nx * grid.ny * grid.nz)).alias("fill"))


def dexels(tri: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, rn, z): hits that enter or leave the outermost shell, in order."""
    w = W.partitionBy("i", "j").orderBy("z", "sign").rowsBetween(W.unboundedPreceding, 0)
    run = hits(tri, grid).withColumn("s", F.sum("sign").over(w))
    kept = run.where("(s = -1 AND sign < 0) OR (s = 0 AND sign > 0)")
    return kept.withColumn("rn", F.row_number().over(W.partitionBy("i", "j").orderBy("z", "sign"))).select("i", "j", "rn", "z")


def spans(dex: DataFrame) -> DataFrame:
    """(i, j, span, z_in, z_out): hits in pairs; a last one without partner is dropped."""
    paired = dex.withColumn("z_out", F.lead("z").over(W.partitionBy("i", "j").orderBy("rn")))
    return paired.where("rn % 2 = 1 AND z_out IS NOT NULL").selectExpr("i", "j", "CAST((rn + 1) DIV 2 AS INT) AS span", "z AS z_in", "z_out")


def nested_spans(dex_spans: DataFrame) -> DataFrame:
    """(i, j, spans): a row a column with its sorted spans."""
    one = F.struct("span", "z_in", "z_out")
    return dex_spans.groupBy("i", "j").agg(F.array_sort(F.collect_list(one)).alias("spans"))
