"""Surfaces and hexahedra of voxels, dexels and octree leaves, with the vertices they use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions.exprs import LEXICOGRAPHIC, RING, SIDES
from geoweave.operators.grids import Grid


def boundary_triangles(inside: DataFrame) -> DataFrame:
    """(i, j, k, axis, dir, part, n0x ... n2z): two triangles, in node numbers, of each side of a voxel inside whose
    neighbour there is not."""
    rows = []
    for (axis, way), pair in SIDES.items():
        d = [0, 0, 0]
        d[axis] = way
        for part, tri in enumerate(pair):
            rows.append((axis, way, part, *d, *(x for c in tri for x in RING[c])))
    names = ["axis", "dir", "part", "di", "dj", "dk", *(f"c{c}{a}" for c in range(3) for a in "xyz")]
    struct = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, r, strict=True)) + ")" for r in rows if r[2] == 0)
    sides = inside.selectExpr("i", "j", "k", f"explode(array({struct})) AS s").selectExpr("i", "j", "k", "s.axis AS axis", "s.dir AS dir", "i + s.di AS ni", "j + s.dj AS nj", "k + s.dk AS nk")
    there = inside.selectExpr("i AS ni", "j AS nj", "k AS nk")
    open_ = sides.join(there, ["ni", "nj", "nk"], "left_anti")
    both = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, r, strict=True)) + ")" for r in rows)
    out = open_.selectExpr("i", "j", "k", "axis", "dir", f"explode(filter(array({both}), t -> t.axis = axis AND t.dir = dir)) AS t")
    node = {"x": "i", "y": "j", "z": "k"}
    return out.selectExpr("i", "j", "k", "axis", "dir", "t.part AS part", *(f"{node[a]} + t.c{c}{a} AS n{c}{a}" for c in range(3) for a in "xyz"))


def surface(inside: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(vertices, facets) of the boundary: nodes once each, scaled so that the grid's longest side is 1; a vertex's
    id is its linear node number, so no rank over all is needed."""
    tri = boundary_triangles(inside)
    nx, ny = grid.nx + 1, grid.ny + 1
    number = lambda c: f"(CAST(n{c}z AS BIGINT) * {ny} + n{c}y) * {nx} + n{c}x"
    longest = float(max(grid.nx, grid.ny, grid.nz))
    nodes = tri.selectExpr("explode(array(" + ", ".join(f"named_struct('vertex_id', {number(c)}, 'x', n{c}x, 'y', n{c}y, 'z', n{c}z)" for c in range(3)) + ")) AS n").select("n.*").distinct()
    facets = tri.selectExpr("CAST(0 AS BIGINT) AS mesh_id", f"((CAST(k AS BIGINT) * {grid.ny} + j) * {grid.nx} + i) * 12 + axis * 4 + (dir + 1) + part AS facet_id", *(f"{number(c)} AS v{c}" for c in range(3)))
    return nodes.selectExpr("CAST(0 AS BIGINT) AS mesh_id", "vertex_id", *(f"{a} / {longest!r}D AS {a}" for a in "xyz")), facets


def hexes(cells: DataFrame, lo: tuple[str, str, str], hi: tuple[str, str, str]) -> DataFrame:
    """cells with corners: eight points between lo and hi, x fastest."""
    corner = ", ".join("named_struct(" + ", ".join(f"'{a}', {(lo, hi)[b][n]}" for n, (a, b) in enumerate(zip("xyz", c, strict=True))) + ")" for c in LEXICOGRAPHIC)
    return cells.withColumn("corners", F.expr(f"array({corner})"))


def voxel_hexes(inside: DataFrame, grid: Grid) -> DataFrame:
    """A hexahedron for each voxel inside, in world coordinates."""
    at = lambda v, a: f"{v} * {grid.h!r}D + {getattr(grid, 'o' + a)!r}D"
    return hexes(inside, tuple(at(v, a) for v, a in zip("ijk", "xyz", strict=True)), tuple(at(f"({v} + 1)", a) for v, a in zip("ijk", "xyz", strict=True)))


def dexel_hexes(spans: DataFrame, grid: Grid) -> DataFrame:
    """A hexahedron for each span, in world coordinates."""
    at = lambda v, a: f"{v} * {grid.h!r}D + {getattr(grid, 'o' + a)!r}D"
    return hexes(spans, (at("i", "x"), at("j", "y"), "z_in"), (at("(i + 1)", "x"), at("(j + 1)", "y"), "z_out"))


def hex_faces(cells: DataFrame) -> DataFrame:
    """Faces of hexahedra (cell_id, n0 ... n7: node numbers, x fastest) with the number of cells on each: 1 border, 2 adjacency."""
    quads = ((0, 2, 6, 4), (1, 3, 7, 5), (0, 1, 5, 4), (2, 3, 7, 6), (0, 1, 3, 2), (4, 5, 7, 6))
    face = ", ".join(f"array_sort(array({', '.join(f'n{c}' for c in q)}))" for q in quads)
    return cells.selectExpr(f"explode(array({face})) AS face").groupBy("face").agg(F.count("*").alias("cells"))
