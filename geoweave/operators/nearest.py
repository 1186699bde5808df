"""Nearest facets of points, and hits of segments, containing cells: joins by overlap with exact residuals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions import exprs as E
from geoweave.operators.boxes import numbered, overlap_join
from geoweave.operators.mesh import CORNERS, facet_boxes


#: Levels of cells, from the largest, that are broadcast.
COARSE = 5


def _flat(met: DataFrame, renamed: dict[str, str]) -> DataFrame:
    return met.select(*(F.col(a).alias(b) for a, b in renamed.items()))


def _solid(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose columns of these names hold numbers, read once and known not to be null: so the join's conditions
    compile to half the code. Methods of more than 8,000 bytes are not compiled by the JVM, which costs far more."""
    from geoweave.plans.session import cut

    rest = [c for c in df.columns if c not in names]
    return cut(df.where(" AND ".join(f"{c} IS NOT NULL" for c in names)).select(*rest, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names)))


def reaches(points: DataFrame, places: DataFrame, k: int = 1, id_col: str = "point_id", axes=E.AXES) -> DataFrame:
    """points (id and axes) with u: a squared distance within which each has k of the places (axes), or all of them if
    there are fewer. Places are counted in cells of powers of two, each with the box around its places; of the cells
    that a point lies in, those with k places bound its distance to them by the far corner of their box. The largest
    cell holds everything; the smallest have about one place, if places are spread evenly. Nothing depends on u but how
    much is looked at."""
    n = len(axes)
    low = points.agg(*(F.min(a) for a in axes), *(F.max(a) for a in axes)).first()
    far = places.agg(*(F.min(a) for a in axes), *(F.max(a) for a in axes), F.count("*")).first()
    if low[0] is None or far[0] is None:
        return points.where("false").withColumn("u", F.lit(0.0))
    origin = [min(low[j], far[j]) for j in range(n)]
    extent = max(max(low[j + n], far[j + n]) - origin[j] for j in range(n))
    top = math.frexp(extent)[1] if extent else 0
    levels = range(top, top - min(24, math.ceil(math.log2(far[2 * n] + 1) / 2) + 2), -1)
    at = f"explode(array({', '.join(map(str, levels))})) AS _level"
    cell = [f"CAST(floor(({a} - {o!r}D) / power(2e0, _level)) AS BIGINT) AS _c{a}" for a, o in zip(axes, origin, strict=True)]
    keys = ["_level", *(f"_c{a}" for a in axes)]
    cells = places.selectExpr(*axes, at).selectExpr("*", *cell).groupBy(*keys).agg(F.count("*").alias("_n"), *(f(a).alias(f"_{m}{a}") for a in axes for m, f in (("min", F.min), ("max", F.max))))
    cells = cells.where(F.col("_n") >= min(k, far[2 * n]))
    off = [f"greatest(abs({a} - _min{a}), abs({a} - _max{a}))" for a in axes]
    placed = points.selectExpr(id_col, *axes, at).selectExpr("*", *cell)
    # the largest cells hold most points, but there are few of them: 8**COARSE at most of the smallest of these levels
    coarse = [placed.where(F.col("_level") > top - COARSE).join(F.broadcast(cells.where(F.col("_level") > top - COARSE)), keys)]
    fine = [placed.where(F.col("_level") <= top - COARSE).join(cells.where(F.col("_level") <= top - COARSE).hint("merge"), keys)] if len(levels) > COARSE else []
    off = [f"greatest(abs({a} - _min{a}), abs({a} - _max{a}))" for a in axes]
    u = None
    for met in coarse + fine:
        one = met.selectExpr(id_col, f"{E.dot(off, off)} AS u")
        u = one if u is None else u.unionByName(one)
    return points.join(u.groupBy(id_col).agg(F.min("u").alias("u")).hint("merge"), id_col)


def _around(points: DataFrame) -> DataFrame:
    """points with the box within u, a little wider for rounding."""
    r = "sqrt(u) * 1.000000000001D"
    return points.selectExpr("*", *(f"{a} - {r} - abs({a}) * 1e-15 AS min{a}" for a in E.AXES), *(f"{a} + {r} + abs({a}) * 1e-15 AS max{a}" for a in E.AXES))


def _off(p, lo, hi) -> str:
    """Squared distance of a point outside a box, 0 within."""
    out = [f"greatest({a} - {x}, {x} - {b}, 0e0)" for x, a, b in zip(p, lo, hi, strict=True)]
    return E.dot(out, out)


def nearest_facet(points: DataFrame, tri: DataFrame, id_col: str = "point_id", digits: int | None = None, place: bool = False) -> DataFrame:
    """(point_id, mesh_id, facet_id, d2): the nearest facet of each point, ties to the smallest mesh and facet; squared
    distances equal up to so many digits are ties, if given. place: also the nearest point (nx, ny, nz) on it. Points
    look at the facets whose boxes are within a bound of their distance, so there is one join and no round; points at one
    place look once."""
    every, points = numbered(points, list(E.AXES), id_col)
    points = points.withColumnRenamed("_kind", id_col)
    facets = facet_boxes(tri)
    held = reaches(points.select(id_col, *E.AXES), E.apply(tri, E.barycentre()).selectExpr(*(f"c{a} AS {a}" for a in E.AXES)), 1, id_col)
    lo, hi = (tuple(f"r_{m}{a}" for a in E.AXES) for m in ("min", "max"))
    box = [f"{m}{a}" for m in ("min", "max") for a in E.AXES]
    met = overlap_join(_solid(_around(held), *E.AXES, "u", *box), _solid(facets, *CORNERS, *box), residual=f"{_off(E.vec('l_'), lo, hi)} <= l_u * 1.000000000001D + 1e-300")
    flat = _flat(met, {f"l_{id_col}": id_col, **{f"l_{a}": f"p{a}" for a in E.AXES}, "r_mesh_id": "mesh_id", "r_facet_id": "facet_id", **{f"r_{c}": c for c in CORNERS}})
    far = E.apply(flat, E.triangle_sq()).withColumn("k", F.round("d2", digits) if digits else F.col("d2"))
    best = far.groupBy(id_col).agg(F.min(F.struct("k", "mesh_id", "facet_id", "d2")).alias("b")).select(id_col, "b.mesh_id", "b.facet_id", "b.d2")
    if place:
        on = best.join(points.selectExpr(id_col, *(f"{a} AS p{a}" for a in E.AXES)).hint("merge"), id_col).join(tri, ["mesh_id", "facet_id"])
        best = E.apply(on, E.nearest_on_triangle()).selectExpr(id_col, "mesh_id", "facet_id", "d2", *(f"{a} AS n{a}" for a in E.AXES))
    return every.join(best.withColumnRenamed(id_col, "_kind").hint("merge"), "_kind").drop("_kind")


def nearest_facet_by_all(points: DataFrame, tri: DataFrame, id_col: str = "point_id") -> DataFrame:
    """The same by trying every facet: what the other is held against. For few facets: Spark joins by nested loops."""
    met = points.selectExpr(id_col, *(f"{a} AS p{a}" for a in E.AXES)).join(tri, F.lit(True))
    return E.apply(met, E.triangle_sq()).groupBy(id_col).agg(F.min(F.struct("d2", "mesh_id", "facet_id")).alias("b")).select(id_col, "b.mesh_id", "b.facet_id", "b.d2")


def nearest_box(points: DataFrame, boxes: DataFrame, id_col: str = "point_id") -> DataFrame:
    """(point_id, mesh_id, d2, c2): the nearest box of each point, ties to the smallest mesh; d2 to the box (inside,
    minus that to its nearest side), c2 to its centre. Points look as in nearest_facet."""
    sides = [f"{m}{a}" for a in E.AXES for m in ("min", "max")]
    held = reaches(points.select(id_col, *E.AXES), boxes.selectExpr(*(f"(min{a} + max{a}) / 2e0 AS {a}" for a in E.AXES)), 1, id_col)
    met = overlap_join(_around(held), boxes.select("mesh_id", *sides))
    flat = _flat(met, {f"l_{id_col}": id_col, **{f"l_{a}": a for a in E.AXES}, "r_mesh_id": "mesh_id", **{f"r_{c}": c for c in sides}})
    lo, hi = (tuple(f"{m}{a}" for a in E.AXES) for m in ("min", "max"))
    far = flat.selectExpr(id_col, "mesh_id", f"{E.point_box_sq(E.AXES, lo, hi)} AS d2", f"{E.point_box_centre_sq(E.AXES, lo, hi)} AS c2")
    return far.groupBy(id_col).agg(F.min(F.struct("d2", "mesh_id", "c2")).alias("b")).select(id_col, "b.mesh_id", "b.d2", "b.c2")


def _pieces(segments: DataFrame, side: float) -> DataFrame:
    """Segments cut into pieces no longer than side along any axis, each with its box, so that a segment meets what is
    along it and not all that is in its box."""
    long = "greatest(" + ", ".join(f"abs(q{a} - p{a})" for a in E.AXES) + ")"
    out = segments.selectExpr("segment_id", *(f"{e}{a}" for e in "pq" for a in E.AXES), f"greatest(1, CAST(ceil({long} / {side!r}D) AS INT)) AS _n")
    out = out.selectExpr("*", "explode(sequence(0, _n - 1)) AS _k")
    ends = {a: [f"(p{a} + (q{a} - p{a}) * (_k + {e}) / _n)" for e in (0, 1)] for a in E.AXES}
    pad = {a: f"1e-12 * (abs(p{a}) + abs(q{a}))" for a in E.AXES}
    return out.selectExpr("*", *(f"least({x}, {y}) - {pad[a]} AS min{a}" for a, (x, y) in ends.items()), *(f"greatest({x}, {y}) + {pad[a]} AS max{a}" for a, (x, y) in ends.items())).drop("_n", "_k")


def _straddled(segments: DataFrame, tri: DataFrame) -> DataFrame:
    """(segment_id, mesh_id, facet_id, f, g: where the ends lie of its plane) of facets that a segment straddles, whose
    boxes it meets; a facet may come once for each piece."""
    box = [f"{m}{a}" for m in ("min", "max") for a in E.AXES]
    ends = [f"{e}{a}" for e in "pq" for a in E.AXES]
    facets = _solid(E.apply(facet_boxes(tri), E.facet_plane()), *CORNERS, *box, "nx", "ny", "nz", "nc")
    side = facets.agg(F.expr("avg(greatest(maxx - minx, maxy - miny, maxz - minz))")).first()[0] or 1.0
    met = overlap_join(_solid(_pieces(segments, side), *ends, *box), facets)
    flat = _flat(met, {**{f"l_{c}": c for c in ("segment_id", *ends)}, **{f"r_{c}": c for c in ("mesh_id", "facet_id", *CORNERS, "nx", "ny", "nz", "nc", *box)}})
    plane, *turns = E.straddles()
    lo, hi = (tuple(f"{m}{a}" for a in E.AXES) for m in ("min", "max"))
    f, g = E.sides()
    return flat.where(plane).where(E.segment_box(E.vec("p"), E.vec("q"), lo, hi)).where(" AND ".join(turns)).selectExpr("segment_id", "mesh_id", "facet_id", f"{f} AS f", f"{g} AS g")


def segment_hits(segments: DataFrame, tri: DataFrame) -> DataFrame:
    """(segment_id, mesh_id, facet_id, param) of facets that a segment (px ... qz) crosses, param: 0 at p, 1 at q."""
    hit = _straddled(segments, tri).groupBy("segment_id", "mesh_id", "facet_id").agg(F.min("f").alias("f"), F.min("g").alias("g"))
    at = hit.selectExpr("segment_id", "mesh_id", "facet_id", "CASE WHEN abs(g - f) < 1e-20 THEN NULL ELSE f / nullif(f - g, 0e0) END AS param")
    return at.where("param >= 0e0 AND param <= 1e0")


def segment_any(segments: DataFrame, tri: DataFrame) -> DataFrame:
    """Segments that cross or touch any facet (semi-join)."""
    return segments.join(_straddled(segments, tri).select("segment_id").distinct(), "segment_id", "left_semi")


def segment_nearest(segments: DataFrame, tri: DataFrame, digits: int | None = None) -> DataFrame:
    """The first facet that a segment crosses, ties (to so many digits of param, if given) to the smallest mesh and facet."""
    hits = segment_hits(segments, tri).withColumn("k", F.round("param", digits) if digits else F.col("param"))
    return hits.groupBy("segment_id").agg(F.min(F.struct("k", "mesh_id", "facet_id", "param")).alias("b")).select("segment_id", "b.param", "b.mesh_id", "b.facet_id")


def segment_nearest_polygon(segments: DataFrame, vertices: DataFrame, corners: DataFrame, digits: int | None = None) -> DataFrame:
    """The first of the polygons (mesh_id, facet_id, corner_no, vertex_id), as fans of triangles, that a segment crosses."""
    from geoweave.operators.mesh import fans, triangles

    return segment_nearest(segments, triangles(vertices, fans(corners)), digits)


def containing_boxes(points: DataFrame, boxes: DataFrame, id_col: str) -> DataFrame:
    """(point_id, id) of boxes that hold a point."""
    slim = boxes.select(id_col, *(f"{m}{a}" for a in E.AXES for m in ("min", "max")))
    around = points.selectExpr("point_id", *(f"{a} AS min{a}" for a in E.AXES), *(f"{a} AS max{a}" for a in E.AXES))
    met = overlap_join(around, slim, alike=("point_id", id_col))
    return met.select(F.col("l_point_id").alias("point_id"), F.col(f"r_{id_col}").alias(id_col))


def containing_tet(points: DataFrame, tets: DataFrame) -> DataFrame:
    """(point_id, cell_id): the smallest id of the tetrahedra (t0x ... t3z) that hold a point; null for none.
    Points at one place are asked for once, and of equal tetrahedra the smallest id."""
    box = [f"{m}{a}" for m in ("min", "max") for a in E.AXES]
    every, points = numbered(points, list(E.AXES), "point_id")
    points = points.withColumnRenamed("_kind", "point_id")
    tets = tets.groupBy(*(f"t{k}{a}" for k in range(4) for a in E.AXES)).agg(F.min("cell_id").alias("cell_id"))
    boxes = tets.selectExpr("cell_id", *(f"t{k}{a}" for k in range(4) for a in E.AXES), *(f"{f}(t0{a}, t1{a}, t2{a}, t3{a}) AS {m}{a}" for a in E.AXES for m, f in (("min", "least"), ("max", "greatest"))))
    held = [f"{c}{a}" for c in ("t0", "t1", "n0", "n1", "n2", "n3") for a in E.AXES]
    solid = _solid(E.apply(boxes, E.tet_planes()).select("cell_id", *held, *box), *held, *box)
    around = points.selectExpr("point_id", *E.AXES, *(f"{a} AS min{a}" for a in E.AXES), *(f"{a} AS max{a}" for a in E.AXES))
    met = overlap_join(_solid(around, *E.AXES, *box), solid)
    flat = _flat(met, {"l_point_id": "point_id", **{f"l_{a}": f"p{a}" for a in E.AXES}, "r_cell_id": "cell_id", **{f"r_{c}": c for c in held}})
    first = flat.where(E.in_planes()).groupBy("point_id").agg(F.min("cell_id").alias("cell_id"))
    return every.join(first.withColumnRenamed("point_id", "_kind").hint("merge"), "_kind", "left").drop("_kind")
