"""Octrees without pointers: cells are keys (level, ix, iy, iz), level 0 the roots, and neighbours, corners and
children are arithmetic on them.

A cell is subdivided if a predicate holds; as a cell lies within its parent, the subdivided cells of each level
follow from the boxes directly, and one sweep from the deepest level up adds what grading (neighbours across
faces and edges differ by one level at most) and pairing (siblings are all leaves or all not) ask for.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.operators.grids import Grid

KEY = ["level", "ix", "iy", "iz"]


@dataclass(frozen=True)
class Lattice:
    """Roots of a grid whose sides are powers of two: cubes of the shortest side."""

    grid: Grid

    @property
    def root(self) -> int:
        return min(self.grid.nx, self.grid.ny, self.grid.nz)

    @property
    def depth(self) -> int:
        return self.root.bit_length() - 1

    @property
    def roots(self) -> tuple[int, int, int]:
        return tuple(n // self.root for n in (self.grid.nx, self.grid.ny, self.grid.nz))

    def extent(self, level: int) -> int:
        """Voxels along a side of a cell."""
        return self.root >> level


def overlapped(boxes: DataFrame, lattice: Lattice, level: int) -> DataFrame:
    """Cells of a level that a box (minx ... maxz) overlaps (closed): one more is tried on each side, for rounding."""
    g, e, out = lattice.grid, lattice.extent(level), boxes
    step = e * g.h
    for a, n in zip("xyz", lattice.roots, strict=True):
        o, most = getattr(g, f"o{a}"), (n << level) - 1
        lo = f"greatest(CAST(ceil((min{a} - {o!r}D) / {step!r}D) AS INT) - 2, 0)"
        hi = f"least(CAST(floor((max{a} - {o!r}D) / {step!r}D) AS INT) + 1, {most})"
        out = out.selectExpr("*", f"explode(CASE WHEN {lo} <= {hi} THEN sequence({lo}, {hi}) ELSE CAST(array() AS array<int>) END) AS i{a}")
        out = out.where(f"i{a} * {step!r}D + {o!r}D <= max{a} AND (i{a} + 1) * {step!r}D + {o!r}D >= min{a}")
    return out.selectExpr(f"{level} AS level", "ix", "iy", "iz").distinct()


def _parents(cells: DataFrame) -> DataFrame:
    return cells.selectExpr("level - 1 AS level", *(f"CAST(floor(i{a} / 2) AS INT) AS i{a}" for a in "xyz")).distinct()


def _moved(cells: DataFrame, moves: list[tuple[int, int, int]], lattice: Lattice, level: int) -> DataFrame:
    """Cells at an offset, within the lattice."""
    at = ", ".join(f"named_struct('x', {x}, 'y', {y}, 'z', {z})" for x, y, z in moves)
    out = cells.selectExpr("level", "ix", "iy", "iz", f"explode(array({at})) AS d").selectExpr("level", *(f"i{a} + d.{a} AS i{a}" for a in "xyz"))
    return out.where(" AND ".join(f"i{a} BETWEEN 0 AND {(n << level) - 1}" for a, n in zip("xyz", lattice.roots, strict=True)))


NEAR = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if 0 < abs(x) + abs(y) + abs(z) < 3]
CHILD = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]


def _siblings(cells: DataFrame) -> DataFrame:
    at = ", ".join(f"named_struct('x', {x}, 'y', {y}, 'z', {z})" for x, y, z in CHILD)
    base = cells.selectExpr("level", *(f"CAST(floor(i{a} / 2) AS INT) * 2 AS i{a}" for a in "xyz")).distinct()
    return base.selectExpr("level", "ix", "iy", "iz", f"explode(array({at})) AS d").selectExpr("level", *(f"i{a} + d.{a} AS i{a}" for a in "xyz"))


def roots(lattice: Lattice, spark) -> DataFrame:
    x, y, z = lattice.roots
    return spark.range(x * y * z).selectExpr("0 AS level", f"CAST(id % {x} AS INT) AS ix", f"CAST((id DIV {x}) % {y} AS INT) AS iy", f"CAST(id DIV {x * y} AS INT) AS iz")


def subdivide(lattice: Lattice, predicate: Callable[[int], DataFrame], spark, graded: bool = False, paired: bool = False, max_cells: int | None = None) -> DataFrame:
    """All subdivided cells; with max_cells those of the upper levels alone, as many levels as make no more cells. predicate(level): the cells of a level that must be, which must include the parents of
    those of the level below. Levels are as many as the depth, so the plan stays small; each is checkpointed."""
    from geoweave.plans.session import cut

    above, done = None, []
    for level in range(lattice.depth - 1, -1, -1):
        cells = predicate(level)
        if above is not None:
            cells = cells.unionByName(above).distinct()
        if paired:
            if level:
                cells = cells.unionByName(_siblings(cells)).distinct()
            else:
                cells = roots(lattice, spark).join(cells.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_semi")
        cells = cut(cells)
        done.append(cells)
        if level:
            above = _parents(cells)
            if graded:
                above = above.unionByName(_parents(_moved(cells, NEAR, lattice, level))).distinct()
    if max_cells is not None:
        held, total = [], math.prod(lattice.roots)
        for cells in reversed(done):  # from the roots down
            total += 8 * cells.count()
            if total > max_cells:
                break
            held.append(cells)
        done = held
    out = roots(lattice, spark).where("false")
    for cells in done:
        out = out.unionByName(cells)
    return out


def all_cells(divided: DataFrame, lattice: Lattice) -> DataFrame:
    """Every cell with is_leaf."""
    at = ", ".join(f"named_struct('x', {x}, 'y', {y}, 'z', {z})" for x, y, z in CHILD)
    children = divided.selectExpr("level + 1 AS level", "ix", "iy", "iz", f"explode(array({at})) AS d").selectExpr("level", *(f"i{a} * 2 + d.{a} AS i{a}" for a in "xyz"))
    cells = children.unionByName(roots(lattice, divided.sparkSession))
    return cells.join(divided.withColumn("_d", F.lit(True)), KEY, "left").selectExpr(*KEY, "_d IS NULL AS is_leaf")


def ungraded(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """Violations of grading: leaves with a subdivided neighbour's child more than one level deeper."""
    divided = cells.where("NOT is_leaf")
    leaves = cells.where("is_leaf").select(*KEY)
    out = None
    for level in range(1, lattice.depth):
        near = _parents(_moved(divided.where(f"level = {level}").select(*KEY), NEAR, lattice, level))
        bad = near.join(leaves, KEY, "left_semi")
        out = bad if out is None else out.unionByName(bad)
    return out if out is not None else leaves.where("false")


def unpaired(cells: DataFrame) -> DataFrame:
    """Violations of pairing: groups of siblings of which some are leaves and some are not."""
    up = cells.selectExpr("level", *(f"CASE WHEN level = 0 THEN 0 ELSE CAST(floor(i{a} / 2) AS INT) END AS p{a}" for a in "xyz"), "CAST(is_leaf AS INT) AS leaf")
    return up.groupBy("level", "px", "py", "pz").agg(F.min("leaf").alias("lo"), F.max("leaf").alias("hi")).where("lo <> hi")


def neighbours(cells: DataFrame) -> DataFrame:
    """(level, ix, iy, iz, axis, dir): cells that have a cell of their own level there."""
    six = [(a, d) for a in range(3) for d in (-1, 1)]
    at = ", ".join(f"named_struct('axis', {a}, 'dir', {d})" for a, d in six)
    moved = cells.selectExpr(*KEY, f"explode(array({at})) AS s").selectExpr(*KEY, "s.axis AS axis", "s.dir AS dir", *(f"i{c} + CASE WHEN s.axis = {n} THEN s.dir ELSE 0 END AS n{c}" for n, c in enumerate("xyz")))
    there = cells.selectExpr("level", *(f"i{a} AS n{a}" for a in "xyz"))
    return moved.join(there, ["level", "nx", "ny", "nz"], "left_semi").select(*KEY, "axis", "dir")


def places(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """cells with the lower corner (x, y, z), side and centre in world coordinates."""
    g = lattice.grid
    side = f"(shiftright({lattice.root}, level) * {g.h!r}D)"
    return cells.selectExpr("*", f"{side} AS side", *(f"i{a} * {side} + {getattr(g, 'o' + a)!r}D AS {a}" for a in "xyz"), *(f"(i{a} + 5e-1) * {side} + {getattr(g, 'o' + a)!r}D AS c{a}" for a in "xyz"))


def inside(cells: DataFrame, tri: DataFrame, lattice: Lattice) -> DataFrame:
    """Every cell, subdivided ones too, with inside: whether an odd number of outermost hits of the vertical ray
    through its centre lies below the centre."""
    from pyspark.sql import Window as W

    from geoweave.functions import exprs as E
    from geoweave.operators.boxes import overlap_join
    from geoweave.operators.mesh import CORNERS, facet_boxes

    placed = places(cells, lattice)
    column = placed.selectExpr("level", "ix", "iy", "cx", "cy").distinct().selectExpr("*", *(f"c{a} AS {m}{a}" for a in "xy" for m in ("min", "max")))
    met = overlap_join(column, facet_boxes(tri), ("x", "y"))
    flat = met.select(*(F.col(f"l_{c}").alias(c) for c in ("level", "ix", "iy", "cx", "cy")), *(F.col(f"r_{c}").alias(c) for c in CORNERS))
    hit = E.apply(flat, E.column_hit("cx", "cy")).where("hit AND sign <> 0")
    w = W.partitionBy("level", "ix", "iy").orderBy("z", "sign").rowsBetween(W.unboundedPreceding, 0)
    kept = hit.withColumn("s", F.sum("sign").over(w)).where("(s = -1 AND sign < 0) OR (s = 0 AND sign > 0)").select("level", "ix", "iy", "z")
    # hits and centres of a column in one order, hits below a centre before it; centres at a hit's height come first
    marks = placed.select(*KEY, "is_leaf", F.col("cz").alias("z"), F.lit(0).alias("hit")).unionByName(kept.selectExpr("level", "ix", "iy", "z", "1 AS hit"), allowMissingColumns=True)
    run = W.partitionBy("level", "ix", "iy").orderBy("z", "hit").rowsBetween(W.unboundedPreceding, 0)
    return marks.withColumn("below", F.sum("hit").over(run)).where("hit = 0").selectExpr(*KEY, "is_leaf", "below % 2 = 1 AS inside")


def numbered(cells: DataFrame) -> DataFrame:
    """(level, ix, iy, iz, hex): the leaves, numbered from 0 in the order of their keys, as hexahedra of a mesh are."""
    from geoweave.operators.mesh import offsets

    leaves = cells.where("is_leaf").select(*KEY).withColumns({"_key": F.struct(*KEY), "_one": F.lit(1)})
    return offsets(leaves, "_key", "_one").select(*KEY, F.col("offset").alias("hex"))
