"""Queries over the driver's tables, each with the plain SQL that it is held against: joins by inequality, cross
products and windows over whole grids, where the operators use bins and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import exprs as E
from geoweave.operators import boxes, grids, mesh, nearest, octree, poisson, ranges, rays, sdf, surface
from geoweave.plans import fixtures
from geoweave.plans.fixtures import frame, sql, tri

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- range and radius joins

PQ = sql("points_evt", "queries_part")
HALF = 4


def _pq(spark, d):
    return frame(spark, d, "points_evt"), frame(spark, d, "queries_part")


def _box(h, axes="xyz") -> str:
    h = h if isinstance(h, dict) else dict.fromkeys(axes, h)
    return " AND ".join(f"p.{a} >= q.q{a} - {h[a]} AND p.{a} <= q.q{a} + {h[a]}" for a in axes)


def _ball(r, op="<", axes="xyz") -> str:
    return "(" + " + ".join(f"(p.{a} - q.q{a}) * (p.{a} - q.q{a})" for a in axes) + f") {op} {r} * {r}"


def _count_sql(on: str) -> str:
    return f"{PQ} SELECT q.query_id, CAST(count(p.point_id) AS BIGINT) AS n FROM queries_part q LEFT JOIN points_evt p ON {on} GROUP BY 1"


@query(_count_sql(_box("4e0")))
def box_count(spark, d):
    p, q = _pq(spark, d)
    return ranges.box_counts(p, q, 4.0)


@query(f"{PQ} SELECT q.query_id, p.point_id FROM queries_part q JOIN points_evt p ON {_box('4e0')}")
def box_report(spark, d):
    p, q = _pq(spark, d)
    return ranges.box_report(p, q, 4.0)


ANISO = {"x": 3.0, "y": 10.0, "z": 6.0}


@query(_count_sql(_box({"x": "3e0", "y": "10e0", "z": "6e0"})))
def box_count_aniso(spark, d):
    p, q = _pq(spark, d)
    return ranges.box_counts(p, q, ANISO)


@query(f"{PQ} SELECT q.query_id, p.point_id FROM queries_part q JOIN points_evt p ON {_box({'x': '3e0', 'y': '10e0', 'z': '6e0'})}")
def box_report_aniso(spark, d):
    p, q = _pq(spark, d)
    return ranges.box_report(p, q, ANISO)


@query(_count_sql(_box("q.half")))
def box_count_by_row(spark, d):
    p, q = _pq(spark, d)
    return ranges.box_counts(p, q, "half")


@query(_count_sql(_box("2e0", "xy")))
def box_count_2d(spark, d):
    p, q = _pq(spark, d)
    return ranges.box_counts(p, q, 2.0, ("x", "y"))


@query(_count_sql(_box("5e-1", "y")))
def box_count_1d(spark, d):
    p, q = _pq(spark, d)
    return ranges.box_counts(p, q, 0.5, ("y",))


@query(_count_sql(_ball("5e0")))
def sphere_count(spark, d):
    p, q = _pq(spark, d)
    return ranges.counts(q, ranges.sphere_report(p, q, 5.0))


@query(_count_sql(_ball("5e0", "<=")))
def sphere_count_closed(spark, d):
    p, q = _pq(spark, d)
    return ranges.counts(q, ranges.sphere_report(p, q, 5.0, closed=True))


@query(_count_sql(_ball("3e0", "<", "xy")))
def sphere_count_2d(spark, d):
    p, q = _pq(spark, d)
    return ranges.counts(q, ranges.sphere_report(p, q, 3.0, ("x", "y")))


@query(f"{PQ} SELECT q.query_id, p.point_id FROM queries_part q JOIN points_evt p ON {_ball('5e0')}")
def sphere_report(spark, d):
    p, q = _pq(spark, d)
    return ranges.sphere_report(p, q, 5.0).select("query_id", "point_id")


@query(f"{PQ} SELECT CAST(count(*) AS BIGINT) AS total FROM queries_part q JOIN points_evt p ON {_ball('5e0')}")
def neighbours_total(spark, d):
    p, q = _pq(spark, d)
    return ranges.counts(q, ranges.sphere_report(p, q, 5.0)).agg(F.sum("n").alias("total"))


@query(f"""{PQ}, r AS (SELECT q.query_id, p.point_id, (p.x - q.qx) * (p.x - q.qx) + (p.y - q.qy) * (p.y - q.qy) + (p.z - q.qz) * (p.z - q.qz) AS d2 FROM queries_part q CROSS JOIN points_evt p),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank FROM r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, round(d2, 6) AS d2 FROM s WHERE rank <= 5""")
def knn(spark, d):
    """The five points nearest to each part."""
    p, q = _pq(spark, d)
    return _round(ranges.knn(p, q, 5), "d2")


@query(f"{PQ} SELECT q.query_id FROM queries_part q WHERE NOT EXISTS (SELECT 1 FROM points_evt p WHERE {_ball('3e0', '<=')})")
def dist_anti(spark, d):
    p, q = _pq(spark, d)
    return ranges.within(p, q, 3.0, closed=True, some=False)


@query(f"{PQ} SELECT q.query_id FROM queries_part q WHERE EXISTS (SELECT 1 FROM points_evt p WHERE {_ball('3e0', '<=')})")
def dist_semi(spark, d):
    p, q = _pq(spark, d)
    return ranges.within(p, q, 3.0, closed=True)


# ---- meshes

TRI = sql("tri")


@query(f"{TRI} SELECT mesh_id, facet_id, {', '.join(f'round({c}, 6) AS {c}' for c in mesh.CORNERS)} FROM tri")
def triangles(spark, d):
    return _round(tri(spark, d), *mesh.CORNERS)


@query(f"{TRI} SELECT mesh_id, facet_id, {', '.join(f'round({e}, 6) AS {n}' for n, e in E.facet_box())} FROM tri")
def facet_bbox(spark, d):
    return _round(mesh.facet_boxes(tri(spark, d)).drop(*mesh.CORNERS), *(n for n, _ in E.facet_box()))


@query(f"{TRI} SELECT mesh_id, facet_id, {', '.join(f'round({e}, 6) AS {n}' for n, e in E.barycentre())} FROM tri")
def facet_barycentre(spark, d):
    return _round(E.apply(tri(spark, d), E.barycentre()).drop(*mesh.CORNERS), "cx", "cy", "cz")


MINMAX = "min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz"
BOX = f"SELECT mesh_id, {MINMAX} FROM vertices GROUP BY mesh_id"


@query(f"{sql('vertices', box=BOX)} SELECT mesh_id, {', '.join(f'round({m}{a}, 6) AS {m}{a}' for a in 'xyz' for m in ('min', 'max'))}, round(greatest(maxx - minx, maxy - miny, maxz - minz), 6) AS extent FROM box")
def mesh_bbox(spark, d):
    return _round(mesh.bbox(frame(spark, d, "vertices")), *(f"{m}{a}" for a in "xyz" for m in ("min", "max")), "extent")


COM = "SELECT mesh_id, sum(v) AS volume, " + ", ".join(f"sum(v * (t0{a} + t1{a} + t2{a}) / 4e0) / nullif(sum(v), 0e0) AS c{a}" for a in "xyz") + " FROM (SELECT *, (t0x * (t1y * t2z - t1z * t2y) + t0y * (t1z * t2x - t1x * t2z) + t0z * (t1x * t2y - t1y * t2x)) / 6e0 AS v FROM tri) GROUP BY mesh_id"


@query(f"{sql('tri', com=COM)} SELECT mesh_id, round(volume, 6) AS volume, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM com")
def mesh_com(spark, d):
    return _round(mesh.centre_of_mass(tri(spark, d)), "volume", "cx", "cy", "cz")


def _normal_sql(at: str) -> str:
    cols = ", ".join(f"round(({a} - {at.format(a=a)}) / greatest(maxx - minx, maxy - miny, maxz - minz), 5) AS {a}" for a in "xyz")
    return f"{sql('tri', box=BOX, com=COM)} SELECT v.mesh_id, v.vertex_id, {cols} FROM vertices v JOIN box USING (mesh_id) JOIN com USING (mesh_id)"


def _normal(origin: str, at: str):
    @query(_normal_sql(at), "normalize_" + origin)
    def run(spark, d):
        return _round(mesh.normalise(frame(spark, d, "vertices"), origin, 1.0, tri(spark, d)), "x", "y", "z", digits=5)


_normal("min", "min{a}")
_normal("bbox_center", "(min{a} + max{a}) / 2e0")
_normal("com", "c{a}")


@query(f"""{sql('vertices').replace('WITH ', 'WITH RECURSIVE ', 1)}, k AS (SELECT p.mesh_id, p.vertex_id AS a, q.vertex_id AS b FROM vertices p JOIN vertices q ON p.mesh_id = q.mesh_id AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 11e-1 * 11e-1),
r AS (SELECT mesh_id, a, b FROM k UNION SELECT r.mesh_id, r.a, k.b FROM r JOIN k ON k.mesh_id = r.mesh_id AND k.a = r.b)
SELECT mesh_id, a AS vertex_id, min(b) AS target FROM r GROUP BY 1, 2""")
def vertex_weld(spark, d):
    return mesh.weld(frame(spark, d, "vertices"), 1.1)


OPEN = "SELECT * FROM facets WHERE facet_id < 10"  # boxes without one side
EDGE = "SELECT mesh_id, facet_id, least(v0, v1) AS a, greatest(v0, v1) AS b FROM o UNION ALL SELECT mesh_id, facet_id, least(v1, v2), greatest(v1, v2) FROM o UNION ALL SELECT mesh_id, facet_id, least(v2, v0), greatest(v2, v0) FROM o"


@query(f"{sql('facets', o=OPEN, e=EDGE)} SELECT mesh_id, a, b FROM e GROUP BY ALL HAVING count(*) = 1")
def mesh_borders(spark, d):
    """The boxes of the fixture are closed: each is opened on purpose, on one side, to have borders."""
    return mesh.borders(frame(spark, d, "facets").where("facet_id < 10"))


@query(f"{sql('facets', o='SELECT * FROM facets', e=EDGE)} SELECT DISTINCT p.mesh_id, p.facet_id AS facet_a, q.facet_id AS facet_b FROM e p JOIN e q ON p.mesh_id = q.mesh_id AND p.a = q.a AND p.b = q.b AND p.facet_id < q.facet_id")
def mesh_adjacency(spark, d):
    return mesh.adjacency(frame(spark, d, "facets"))


@query(f"{sql('vertices', 'facets')} SELECT mesh_id, vertex_id FROM vertices v WHERE NOT EXISTS (SELECT 1 FROM facets f WHERE f.mesh_id = v.mesh_id AND f.facet_id < 2 AND v.vertex_id IN (f.v0, f.v1, f.v2))")
def isolated_vertices(spark, d):
    """Of each box two facets are left on purpose, so that there are vertices that none uses."""
    return mesh.isolated(frame(spark, d, "vertices"), frame(spark, d, "facets").where("facet_id < 2")).select("mesh_id", "vertex_id")


@query("SELECT o_orderkey, l_n AS n, CAST(sum(l_n) OVER (ORDER BY o_orderkey) - l_n AS BIGINT) AS \"offset\" FROM (SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS l_n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def offsets_scan(spark, d):
    o, l = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    n = l.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    counted = o.join(n, o.o_orderkey == n.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))
    return mesh.offsets(counted, "o_orderkey", "n")


# ---- overlap joins, containment, segments, nearest facets

FB = "SELECT mesh_id * 12 + facet_id AS fid, " + ", ".join(f"list_{f}([t0{a}, t1{a}, t2{a}]) AS {f}{a}" for a in "xyz" for f in ("min", "max")) + " FROM tri"
#: Two boxes overlap unless one lies beyond the other along an axis.
APART = "NOT (" + " OR ".join(f"p.max{a} < q.min{a} OR q.max{a} < p.min{a}" for a in "xyz") + ")"


def _fb(spark, d):
    return mesh.facet_boxes(tri(spark, d)).withColumn("fid", F.expr("mesh_id * 12 + facet_id"))


@query(f"{sql('tri', fb=FB)} SELECT p.fid AS fid_a, q.fid AS fid_b FROM fb p JOIN fb q ON p.fid <= q.fid AND {APART}")
def bbox_self_join(spark, d):
    return boxes.self_overlap(_fb(spark, d), "fid")


QBOX = "SELECT query_id, " + ", ".join(f"q{a} / {s}e0 - half AS min{a}, q{a} / {s}e0 + half AS max{a}" for a, s in zip("xyz", (2, 5, 30), strict=True)) + " FROM queries_part"


def _qbox(spark, d):
    return frame(spark, d, "queries_part").selectExpr("query_id", *(e for a, s in zip("xyz", (2, 5, 30), strict=True) for e in (f"q{a} / {s}e0 - half AS min{a}", f"q{a} / {s}e0 + half AS max{a}")))


@query(f"{sql('queries_part', 'tri', fb=FB, qb=QBOX)} SELECT q.query_id, p.fid FROM qb q JOIN fb p ON {APART}")
def box_facet_join(spark, d):
    met = boxes.overlap_join(_qbox(spark, d), _fb(spark, d).select("fid", *(n for n, _ in E.facet_box())), alike=("query_id", "fid"))
    return met.select(F.col("l_query_id").alias("query_id"), F.col("r_fid").alias("fid"))


TETBOX = "SELECT cell_id, " + ", ".join(f"{f}(t0{a}, t1{a}, t2{a}, t3{a}) AS {m}{a}" for a in "xyz" for m, f in (("min", "least"), ("max", "greatest"))) + " FROM tets"


@query(f"{sql('queries_part', 'tets', tb=TETBOX, qb=QBOX)} SELECT q.query_id, p.cell_id FROM qb q JOIN tb p ON {APART}")
def box_cell_join(spark, d):
    tets = frame(spark, d, "tets").selectExpr("cell_id", *(f"{f}(t0{a}, t1{a}, t2{a}, t3{a}) AS {m}{a}" for a in "xyz" for m, f in (("min", "least"), ("max", "greatest"))))
    return boxes.overlap_join(_qbox(spark, d), tets).select(F.col("l_query_id").alias("query_id"), F.col("r_cell_id").alias("cell_id"))


@query(f"{sql('probes', 'tets', tb=TETBOX)} SELECT p.point_id, b.cell_id FROM probes p JOIN tb b ON p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy AND p.z BETWEEN minz AND maxz")
def containing_boxes(spark, d):
    tets = frame(spark, d, "tets").selectExpr("cell_id", *(f"{f}(t0{a}, t1{a}, t2{a}, t3{a}) AS {m}{a}" for a in "xyz" for m, f in (("min", "least"), ("max", "greatest"))))
    return nearest.containing_boxes(frame(spark, d, "probes"), tets, "cell_id")


#: The fixture's tetrahedra have three edges along the axes, so that a point's shares of these edges tell.
SHARE = {a: f"(p.{a} - t.t0{a}) / (t.t{k}{a} - t.t0{a})" for k, a in enumerate("xyz", 1)}


@query(f"{sql('probes', 'tets')} SELECT p.point_id, min(t.cell_id) AS cell_id FROM probes p LEFT JOIN tets t ON {' AND '.join(f'{e} >= 0' for e in SHARE.values())} AND {' + '.join(SHARE.values())} <= 1 GROUP BY 1")
def point_in_tet(spark, d):
    return nearest.containing_tet(frame(spark, d, "probes"), frame(spark, d, "tets"))


def _across(a: str, b: str) -> list[str]:
    return [f"{a}{u} * {b}{v} - {a}{v} * {b}{u}" for u, v in (("y", "z"), ("z", "x"), ("x", "y"))]


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{x} * {b}{x}" for x in "xyz") + ")"


def _cols(name: str, values) -> str:
    return ", ".join(f"{v} AS {name}{a}" for a, v in zip("xyz", values, strict=True))


#: Where a segment meets a triangle: shares u, v of two edges and w of the segment, by Cramer's rule.
SEG = {
    "s0": f"SELECT *, {_cols('d', [f'q{a} - p{a}' for a in 'xyz'])}, {_cols('e', [f't1{a} - t0{a}' for a in 'xyz'])}, {_cols('f', [f't2{a} - t0{a}' for a in 'xyz'])}, {_cols('s', [f'p{a} - t0{a}' for a in 'xyz'])} FROM segments CROSS JOIN tri",
    "s1": f"SELECT *, {_cols('h', _across('d', 'f'))}, {_cols('k', _across('s', 'e'))} FROM s0",
    "s2": f"SELECT segment_id, mesh_id, facet_id, {_dot('s', 'h')} / det AS u, {_dot('d', 'k')} / det AS v, {_dot('f', 'k')} / det AS w FROM (SELECT *, {_dot('e', 'h')} AS det FROM s1) WHERE det <> 0",
    "h": "SELECT * FROM s2 WHERE u > 0 AND v > 0 AND u + v < 1 AND w BETWEEN 0 AND 1",
}
FIRST = "SELECT segment_id, round(w, 6) AS param, mesh_id, facet_id FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY round(w, 9), mesh_id, facet_id) AS rn FROM h) WHERE rn = 1"


@query(f"{sql('segments', 'tri', **SEG)} SELECT DISTINCT segment_id FROM h")
def segment_any(spark, d):
    return nearest.segment_any(frame(spark, d, "segments"), tri(spark, d)).select("segment_id")


@query(f"{sql('segments', 'tri', **SEG)} {FIRST}")
def segment_nearest(spark, d):
    return _round(nearest.segment_nearest(frame(spark, d, "segments"), tri(spark, d), digits=9), "param")


@query(f"{sql('segments', 'tri', **(SEG | {'h': SEG['h'].replace('*', 'segment_id, mesh_id, facet_id // 2 AS facet_id, w', 1)}))} {FIRST}")
def segment_polygon(spark, d):
    """The sides of the boxes as polygons of four corners: two triangles of the fixture with a common first corner."""
    corner = "explode(CASE WHEN facet_id % 2 = 0 THEN array(named_struct('n', 0, 'v', v0), named_struct('n', 1, 'v', v1), named_struct('n', 2, 'v', v2)) ELSE array(named_struct('n', 3, 'v', v2)) END) AS c"
    sides = frame(spark, d, "facets").selectExpr("mesh_id", "facet_id DIV 2 AS facet_id", corner).selectExpr("mesh_id", "facet_id", "c.n AS corner_no", "c.v AS vertex_id")
    return _round(nearest.segment_nearest_polygon(frame(spark, d, "segments"), frame(spark, d, "vertices"), sides, digits=9), "param")


SLAB = E.slab(E.vec("p"), E.vec("q"), *((tuple(f"{m}{a}" for a in "xyz")) for m in ("min", "max")))


#: A segment meets a box unless an axis of the box, or one across it and the segment, parts them.
PARTED = " AND ".join([f"least(p{a}, q{a}) <= max{a} AND greatest(p{a}, q{a}) >= min{a}" for a in "xyz"] + [f"abs((q{u} - p{u}) * (p{v} + q{v} - min{v} - max{v}) - (q{v} - p{v}) * (p{u} + q{u} - min{u} - max{u})) <= (max{u} - min{u}) * abs(q{v} - p{v}) + (max{v} - min{v}) * abs(q{u} - p{u})" for u, v in ("yz", "zx", "xy")])


@query(f"{sql('segments', 'vertices', box=BOX)} SELECT segment_id, mesh_id FROM segments JOIN box ON {PARTED}")
def segment_slab(spark, d):
    s = frame(spark, d, "segments").selectExpr("*", *(f"least(p{a}, q{a}) AS min{a}" for a in "xyz"), *(f"greatest(p{a}, q{a}) AS max{a}" for a in "xyz"))
    met = boxes.overlap_join(s, mesh.bbox(frame(spark, d, "vertices")))
    flat = met.selectExpr("l_segment_id AS segment_id", "r_mesh_id AS mesh_id", *(f"l_{e}{a} AS {e}{a}" for e in "pq" for a in "xyz"), *(f"r_{m}{a} AS {m}{a}" for m in ("min", "max") for a in "xyz"))
    return E.apply(flat, SLAB).where("slab").select("segment_id", "mesh_id")


#: The fixture's facets are sides of boxes, so that the nearest one is that of a box: outside, where the point is
#: clamped to; inside, along the axis of the nearest side (of equal ones z, then y, as facets are numbered).
_IN = " AND ".join(f"{a} BETWEEN min{a} AND max{a}" for a in "xyz")
_NEAR = "least(" + ", ".join(f"{a} - min{a}, max{a} - {a}" for a in "xyz") + ")"
_SIDE_OF = {a: f"least({a} - min{a}, max{a} - {a})" for a in "zyx"}
_AXIS = "CASE " + " ".join(f"WHEN round({e}, 9) = round({_NEAR}, 9) THEN '{a}'" for a, e in _SIDE_OF.items()) + " END"
ONBOX = f"SELECT *, {_dot('e', 'e')} AS d2 FROM (SELECT *, {_cols('e', [f'{a} - n{a}' for a in 'xyz'])} FROM (SELECT *, {_cols('n', [f'CASE WHEN NOT inside THEN greatest(min{a}, least({a}, max{a})) WHEN axis <> {a!r} THEN {a} WHEN {a} - min{a} <= max{a} - {a} THEN min{a} ELSE max{a} END' for a in 'xyz'])} FROM (SELECT *, {_IN} AS inside, {_AXIS} AS axis FROM {{}} CROSS JOIN box)))"


@query(f"{sql('probes', 'vertices', box=BOX, h=ONBOX.format('probes'))} SELECT point_id, mesh_id, round(d2, 6) AS d2, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(d2, 9), mesh_id) AS rn FROM h) WHERE rn = 1")
def nearest_facet(spark, d):
    found = nearest.nearest_facet(frame(spark, d, "probes"), tri(spark, d), digits=9, place=True)
    return _round(found.drop("facet_id"), "d2", "nx", "ny", "nz")


CLAMPED = " + ".join(f"(p.{a} - greatest(min{a}, least(p.{a}, max{a}))) ** 2" for a in "xyz")
PBOX = f"SELECT p.point_id, b.mesh_id, round(CASE WHEN {_IN} THEN -({_NEAR} ** 2) ELSE {CLAMPED} END, 6) AS d2, round({' + '.join(f'(p.{a} - (min{a} + max{a}) / 2) ** 2' for a in 'xyz')}, 6) AS c2"


@query(f"{sql('probes', 'vertices', box=BOX)} {PBOX} FROM probes p JOIN box b ON {' AND '.join(f'p.{a} BETWEEN min{a} - 1 AND max{a} + 1' for a in 'xyz')}")
def point_box_distance(spark, d):
    """Of each point and the boxes that are at most 1 away from it along each axis."""
    around = frame(spark, d, "probes").selectExpr("*", *(f"{a} {sign} 1 AS {m}{a}" for a in "xyz" for m, sign in (("min", "-"), ("max", "+"))))
    met = boxes.overlap_join(around, mesh.bbox(frame(spark, d, "vertices")), alike=("point_id", "mesh_id"))
    lo, hi = (tuple(f"r_{m}{a}" for a in "xyz") for m in ("min", "max"))
    return _round(met.selectExpr("l_point_id AS point_id", "r_mesh_id AS mesh_id", f"{E.point_box_sq(E.vec('l_'), lo, hi)} AS d2", f"{E.point_box_centre_sq(E.vec('l_'), lo, hi)} AS c2"), "d2", "c2")


@query(f"{sql('probes', 'vertices', box=BOX)}, h AS ({PBOX.replace('round(', '(').replace(', 6)', ')')} FROM probes p CROSS JOIN box b) SELECT point_id, mesh_id, round(d2, 6) AS d2, round(c2, 6) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, mesh_id) AS rn FROM h) WHERE rn = 1")
def point_nearest_box(spark, d):
    return _round(nearest.nearest_box(frame(spark, d, "probes"), mesh.bbox(frame(spark, d, "vertices"))), "d2", "c2")


# ---- grids, rays, voxels

VOX = 48


def _grid_sql(n: int | None, h: str | None = None, padding: int = 0, up: bool = True) -> str:
    step = f"greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / {n}e0" if n else h
    f = "ceil" if up else "floor"
    return f"SELECT h, {', '.join(f'l{a} - {padding}e0 * h AS o{a}, CAST({f}((u{a} - l{a}) / h) AS INTEGER) + {2 * padding} AS n{a}' for a in 'xyz')} FROM (SELECT {step} AS h, {', '.join(f'min({a}) AS l{a}, max({a}) AS u{a}' for a in 'xyz')} FROM vertices)"


CELLS = "SELECT i, j, CAST(k AS INTEGER) AS k, (k + 5e-1) * h + oz AS c FROM (SELECT i, j, unnest(range(nz)) AS k, h, oz FROM (SELECT i, unnest(range(ny)) AS j, nz, h, oz FROM (SELECT unnest(range(nx)) AS i, ny, nz, h, oz FROM g)))"
COLS = "SELECT i, unnest(range(ny)) AS j, (i + 5e-1) * h + ox AS px, h, oy FROM (SELECT unnest(range(nx)) AS i, ny, h, ox, oy FROM g)"
COLS = f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, px, (j + 5e-1) * h + oy AS py FROM ({COLS})"
#: A column that stands on a box meets its bottom, then its top.
ALLHITS = "SELECT i, j, unnest([minz, maxz]) AS z, unnest([-1, 1]) AS sign FROM cols JOIN box ON px > minx AND px < maxx AND py > miny AND py < maxy"
SIGNED = "SELECT * FROM allhits WHERE sign <> 0"
GRID = {"g": _grid_sql(VOX), "cols": COLS, "box": BOX, "allhits": ALLHITS, "hits": SIGNED}
INSIDE = "SELECT c.i, c.j, c.k FROM cells c JOIN hits h ON h.i = c.i AND h.j = c.j AND h.z < c.c GROUP BY 1, 2, 3 HAVING sum(h.sign) < 0"
VOXELS = {**GRID, "cells": CELLS, "ins": INSIDE}


def _grid(spark, d, **more):
    return grids.grid_of(frame(spark, d, "vertices"), **({"num_voxels": VOX} | more))


def _voxels(spark, d):
    g = _grid(spark, d)
    return rays.voxelise(tri(spark, d), g), g


@query(f"{sql('vertices', g=_grid_sql(VOX))} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, k, round((i + 5e-1) * h + ox, 6) AS x, round((j + 5e-1) * h + oy, 6) AS y, round((k + 5e-1) * h + oz, 6) AS z, CAST((k * ny + j) * nx + i AS BIGINT) AS n FROM ({CELLS}) CROSS JOIN (SELECT * EXCLUDE (i, j, k) FROM (SELECT 0 AS i, 0 AS j, 0 AS k, * FROM g))")
def grid_cells(spark, d):
    g = _grid(spark, d)
    out = g.cells(spark).selectExpr("i", "j", "k", *(f"round({g.centre(a, v)}, 6) AS {a}" for a, v in zip("xyz", "ijk", strict=True)), f"{E.linear_index('i', 'j', 'k', g.nx, g.ny)} AS n")
    return out


@query(f"{sql('tri', **GRID)} SELECT i, j, round(z, 6) AS z, sign FROM hits")
def ray_hits(spark, d):
    return _round(rays.hits(tri(spark, d), _grid(spark, d)), "z")


@query(f"{sql('tri', **VOXELS)} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, k FROM ins")
def voxelize(spark, d):
    return _voxels(spark, d)[0]


@query(f"{sql('tri', **VOXELS)} SELECT round(100e0 * (SELECT count(*) FROM ins) / (SELECT CAST(nx * ny * nz AS DOUBLE) FROM g), 6) AS fill")
def fill_fraction(spark, d):
    return _round(rays.fill_fraction(*_voxels(spark, d)), "fill")


REDUCED = "SELECT i, j, z, row_number() OVER (PARTITION BY i, j ORDER BY z, sign) AS rn FROM (SELECT *, sum(sign) OVER (PARTITION BY i, j ORDER BY z, sign ROWS UNBOUNDED PRECEDING) AS s FROM hits) WHERE (s = -1 AND sign < 0) OR (s = 0 AND sign > 0)"


@query(f"{sql('tri', **GRID, dex=REDUCED)} SELECT i, j, CAST(rn AS INTEGER) AS rn, round(z, 6) AS z FROM dex")
def dexelize(spark, d):
    return _round(rays.dexels(tri(spark, d), _grid(spark, d)), "z")


SPANS = "SELECT p.i, p.j, CAST((p.rn + 1) // 2 AS INTEGER) AS span, p.z AS z_in, q.z AS z_out FROM dex p JOIN dex q ON p.i = q.i AND p.j = q.j AND q.rn = p.rn + 1 WHERE p.rn % 2 = 1"


@query(f"{sql('tri', **GRID, dex=REDUCED, sp=SPANS)} SELECT i, j, span, round(z_in, 6) AS z_in, round(z_out, 6) AS z_out FROM sp")
def dexel_spans(spark, d):
    return _round(rays.spans(rays.dexels(tri(spark, d), _grid(spark, d))), "z_in", "z_out")


_OFF = {(0, -1): "-1, 0, 0", (0, 1): "1, 0, 0", (1, -1): "0, -1, 0", (1, 1): "0, 1, 0", (2, -1): "0, 0, -1", (2, 1): "0, 0, 1"}
_SIDES = "(VALUES " + ", ".join(f"({a}, {w}, {part}, {_OFF[a, w]}, {', '.join(str(x) for c in t for x in E.RING[c])})" for (a, w), pair in E.SIDES.items() for part, t in enumerate(pair)) + ") AS s(axis, dir, part, di, dj, dk, " + ", ".join(f"c{c}{a}" for c in range(3) for a in "xyz") + ")"


@query(f"{sql('tri', **VOXELS)} SELECT CAST(v.i AS INTEGER) AS i, CAST(v.j AS INTEGER) AS j, v.k, axis, dir, part, {', '.join(f'CAST(v.{n} + c{c}{a} AS INTEGER) AS n{c}{a}' for c in range(3) for a, n in zip('xyz', 'ijk', strict=True))} FROM ins v CROSS JOIN {_SIDES} WHERE NOT EXISTS (SELECT 1 FROM ins o WHERE o.i = v.i + di AND o.j = v.j + dj AND o.k = v.k + dk)")
def voxel_surface(spark, d):
    return surface.boundary_triangles(_voxels(spark, d)[0])


_NODES = ", ".join(f"v.{n} + c{c}{a} AS n{c}{a}" for c in range(3) for a, n in zip("xyz", "ijk", strict=True))
_OUTER = {**VOXELS, "outer_": f"SELECT v.i, v.j, v.k, axis, dir, part, {_NODES} FROM ins v CROSS JOIN {_SIDES} WHERE NOT EXISTS (SELECT 1 FROM ins o WHERE o.i = v.i + di AND o.j = v.j + dj AND o.k = v.k + dk)"}
_NODE = "(CAST(n{0}z AS BIGINT) * (ny + 1) + n{0}y) * (nx + 1) + n{0}x"


@query(f"{sql('tri', **_OUTER)} SELECT DISTINCT vertex_id, round(x / m, 6) AS x, round(y / m, 6) AS y, round(z / m, 6) AS z FROM ({' UNION ALL '.join(f'SELECT {_NODE.format(c)} AS vertex_id, n{c}x AS x, n{c}y AS y, n{c}z AS z, CAST(greatest(nx, ny, nz) AS DOUBLE) AS m FROM outer_ CROSS JOIN g' for c in range(3))})")
def surface_vertices(spark, d):
    return _round(surface.surface(*_voxels(spark, d))[0].drop("mesh_id"), "x", "y", "z")


@query(f"{sql('tri', **_OUTER)} SELECT i, j, k, axis, dir, part, {', '.join(f'{_NODE.format(c)} AS v{c}' for c in range(3))} FROM (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, k, axis, dir, part, {', '.join(f'n{c}{a}' for c in range(3) for a in 'xyz')}, nx, ny FROM outer_ CROSS JOIN g)")
def surface_facets(spark, d):
    """The facets with the voxel and side that their ids stand for."""
    inside, g = _voxels(spark, d)
    at = [f"CAST({e} AS INT) AS {n}" for n, e in (("i", f"(facet_id DIV 12) % {g.nx}"), ("j", f"(facet_id DIV {12 * g.nx}) % {g.ny}"), ("k", f"facet_id DIV {12 * g.nx * g.ny}"), ("axis", "(facet_id % 12) DIV 4"), ("dir", "((facet_id % 4) DIV 2) * 2 - 1"), ("part", "facet_id % 2"))]
    return surface.surface(inside, g)[1].selectExpr(*at, "v0", "v1", "v2")


def _corner_sql(lo, hi) -> str:
    return ", ".join(f"round({(lo, hi)[b][n]}, 6) AS c{k}{a}" for k, c in enumerate(E.LEXICOGRAPHIC) for n, (a, b) in enumerate(zip("xyz", c, strict=True)))


def _corner_cols(df: DataFrame, *keys: str) -> DataFrame:
    return df.selectExpr(*keys, *(f"round(corners[{k}].{a}, 6) AS c{k}{a}" for k in range(8) for a in "xyz"))


_VLO, _VHI = (tuple(f"({n} + {s}) * h + o{a}" for n, a in zip("ijk", "xyz", strict=True)) for s in (0, 1))


@query(f"{sql('tri', **VOXELS)} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, k, {_corner_sql(_VLO, _VHI)} FROM ins CROSS JOIN g")
def voxel_hexes(spark, d):
    inside, g = _voxels(spark, d)
    return _corner_cols(surface.voxel_hexes(inside, g), "i", "j", "k")


@query(f"{sql('tri', **GRID, dex=REDUCED, sp=SPANS)} SELECT i, j, span, {_corner_sql((*_VLO[:2], 'z_in'), (*_VHI[:2], 'z_out'))} FROM sp CROSS JOIN g")
def dexel_hexes(spark, d):
    g = _grid(spark, d)
    return _corner_cols(surface.dexel_hexes(rays.spans(rays.dexels(tri(spark, d), g)), g), "i", "j", "span")


# ---- distance fields

FIELD = {"g": _grid_sql(16, padding=2, up=False), "cols": COLS, "box": BOX, "allhits": ALLHITS, "cells": CELLS}
CENTRES = "SELECT c.i, c.j, c.k, (c.i + 5e-1) * h + ox AS px, (c.j + 5e-1) * h + oy AS py, c AS pz FROM cells c CROSS JOIN g"
DIST = f"SELECT i, j, k, sqrt(min(d2)) AS value FROM ({ONBOX.format('(SELECT i, j, k, px AS x, py AS y, pz AS z FROM centres)')}) GROUP BY 1, 2, 3"
PAIRED = "SELECT i, j, z, lead(z) OVER w AS z2, row_number() OVER w AS rn FROM allhits WINDOW w AS (PARTITION BY i, j ORDER BY z)"
FLIPS = "SELECT c.i, c.j, c.k, count(*) AS n FROM cells c CROSS JOIN g JOIN paired p ON p.i = c.i AND p.j = c.j WHERE rn % 2 = 1 AND z2 IS NOT NULL AND round((z - oz) / h) <= c.k AND c.k < round((z2 - oz) / h) GROUP BY 1, 2, 3"


def _field(spark, d):
    return _grid(spark, d, num_voxels=16, padding=2, up=False)


@query(f"{sql('tri', **FIELD, centres=CENTRES, dist=DIST)} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, k, round(CAST(value AS FLOAT)::DOUBLE, 4) AS value FROM dist")
def sdf_unsigned(spark, d):
    f = sdf.unsigned(tri(spark, d), _field(spark, d))
    return f.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"{sql('tri', **FIELD, centres=CENTRES, dist=DIST, paired=PAIRED, flips=FLIPS)} SELECT CAST(d.i AS INTEGER) AS i, CAST(d.j AS INTEGER) AS j, d.k, round(CAST(CASE WHEN n % 2 = 1 THEN -value ELSE value END AS FLOAT)::DOUBLE, 4) AS value FROM dist d LEFT JOIN flips f ON f.i = d.i AND f.j = d.j AND f.k = d.k")
def sdf_signed(spark, d):
    t, g = tri(spark, d), _field(spark, d)
    f = sdf.signed(sdf.unsigned(t, g), t, g)
    return f.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"{sql('tri', **FIELD, paired=PAIRED, flips=FLIPS)} SELECT CAST(c.i AS INTEGER) AS i, CAST(c.j AS INTEGER) AS j, c.k, CASE WHEN n % 2 = 1 THEN -1e0 ELSE 1e0 END AS value FROM cells c LEFT JOIN flips f ON f.i = c.i AND f.j = c.j AND f.k = c.k")
def sdf_voxelize_only(spark, d):
    return sdf.signs(tri(spark, d), _field(spark, d)).withColumn("value", F.col("value").cast("double"))


# ---- octrees

OCT = 32


def _lattice(spark, d):
    return octree.Lattice(_grid(spark, d, num_voxels=OCT, pow2=True))


#: At sf0.01 the scene is flat, so the shortest side of the grid decides the depth; the SQL builds all levels up to it.
LEVELS = 5
_G = _grid_sql(OCT).replace("CAST(ceil(", "CAST(pow(2, ceil(log2(ceil(").replace(" AS INTEGER) + 0 AS", "))) AS INTEGER) AS")


def _octree_sql(graded: bool = False, paired: bool = False) -> str:
    """CTEs d0 ... d(LEVELS-1): the subdivided cells of each level, from the deepest up; cells has them all."""
    parts = {"g": _G, "m": "SELECT *, least(nx, ny, nz) AS root, CAST(log2(least(nx, ny, nz)) AS INTEGER) AS depth FROM g", "fb": FB}
    for level in range(LEVELS - 1, -1, -1):
        cells = f"SELECT {level} AS level, ix, iy, unnest(range((nz // root) << {level})) AS iz FROM (SELECT ix, unnest(range((ny // root) << {level})) AS iy, nz, root FROM (SELECT unnest(range((nx // root) << {level})) AS ix, ny, nz, root FROM m))"
        over = " AND ".join(f"i{a} * ((root >> {level}) * h) + o{a} <= max{a} AND (i{a} + 1) * ((root >> {level}) * h) + o{a} >= min{a}" for a in "xyz")
        parts[f"l{level}"] = cells
        own = f"SELECT DISTINCT level, ix, iy, iz FROM l{level} CROSS JOIN m JOIN fb ON {over} WHERE {level} < depth"
        if level + 1 < LEVELS:
            own += f" UNION SELECT {level}, ix // 2, iy // 2, iz // 2 FROM d{level + 1}"
            if graded:
                near = "(VALUES " + ", ".join(f"({x}, {y}, {z})" for x, y, z in octree.NEAR) + ") AS n(x, y, z)"
                inside = " AND ".join(f"i{a} + n.{a} BETWEEN 0 AND ((n{a} // root) << {level + 1}) - 1" for a in "xyz")
                own += f" UNION SELECT {level}, (ix + n.x) // 2, (iy + n.y) // 2, (iz + n.z) // 2 FROM d{level + 1} CROSS JOIN {near} CROSS JOIN m WHERE {inside}"
        if paired:
            eight = "(VALUES " + ", ".join(f"({x}, {y}, {z})" for x, y, z in octree.CHILD) + ") AS n(x, y, z)"
            parts[f"s{level}"] = own
            if level:
                own = f"SELECT DISTINCT {level} AS level, (ix // 2) * 2 + n.x AS ix, (iy // 2) * 2 + n.y AS iy, (iz // 2) * 2 + n.z AS iz FROM s{level} CROSS JOIN {eight}"
            else:
                own = "SELECT 0 AS level, ix, iy, iz FROM l0 WHERE EXISTS (SELECT 1 FROM s0)"
        parts[f"d{level}"] = own
    parts["divided"] = " UNION ALL ".join(f"SELECT * FROM d{v}" for v in range(LEVELS))
    eight = "(VALUES " + ", ".join(f"({x}, {y}, {z})" for x, y, z in octree.CHILD) + ") AS n(x, y, z)"
    parts["allcells"] = f"SELECT level + 1 AS level, ix * 2 + n.x AS ix, iy * 2 + n.y AS iy, iz * 2 + n.z AS iz FROM divided CROSS JOIN {eight} UNION ALL SELECT 0, ix, iy, iz FROM l0"
    parts["cells"] = "SELECT CAST(a.level AS INTEGER) AS level, CAST(a.ix AS INTEGER) AS ix, CAST(a.iy AS INTEGER) AS iy, CAST(a.iz AS INTEGER) AS iz, d.level IS NULL AS is_leaf FROM allcells a LEFT JOIN divided d ON d.level = a.level AND d.ix = a.ix AND d.iy = a.iy AND d.iz = a.iz"
    return sql("tri", **parts)


def _divided(spark, d, **how):
    lattice, b = _lattice(spark, d), _fb(spark, d)
    return octree.subdivide(lattice, lambda level: octree.overlapped(b, lattice, level), spark, **how), lattice


@query(f"{_octree_sql()} SELECT * FROM cells")
def octree_cells(spark, d):
    return octree.all_cells(*_divided(spark, d))


@query(f"{_octree_sql()} SELECT level, ix, iy, iz FROM cells WHERE is_leaf")
def octree_leaves(spark, d):
    return octree.all_cells(*_divided(spark, d)).where("is_leaf").drop("is_leaf")


@query(f"{_octree_sql(graded=True)} SELECT * FROM cells")
def octree_graded(spark, d):
    return octree.all_cells(*_divided(spark, d, graded=True))


@query(f"{_octree_sql(graded=True, paired=True)} SELECT * FROM cells")
def octree_paired(spark, d):
    return octree.all_cells(*_divided(spark, d, graded=True, paired=True))


@query(f"{_octree_sql()} SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (WHERE is_leaf) AS BIGINT) AS leaves FROM cells")
def octree_counts(spark, d):
    return octree.all_cells(*_divided(spark, d)).agg(F.count("*").alias("cells"), F.count_if("is_leaf").alias("leaves"))


@query("SELECT CAST(0 AS BIGINT) AS ungraded, CAST(0 AS BIGINT) AS unpaired")
def octree_violations(spark, d):
    divided, lattice = _divided(spark, d, graded=True, paired=True)
    cells = octree.all_cells(divided, lattice)
    a, b = octree.ungraded(cells, lattice).agg(F.count("*").alias("ungraded")), octree.unpaired(cells).agg(F.count("*").alias("unpaired"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


@query(f"{_octree_sql()} SELECT c.level, c.ix, c.iy, c.iz, s.axis, s.dir FROM cells c CROSS JOIN (VALUES (0, -1), (0, 1), (1, -1), (1, 1), (2, -1), (2, 1)) AS s(axis, dir) WHERE EXISTS (SELECT 1 FROM cells o WHERE o.level = c.level AND o.ix = c.ix + CASE WHEN s.axis = 0 THEN s.dir ELSE 0 END AND o.iy = c.iy + CASE WHEN s.axis = 1 THEN s.dir ELSE 0 END AND o.iz = c.iz + CASE WHEN s.axis = 2 THEN s.dir ELSE 0 END)")
def octree_neighbours(spark, d):
    return octree.neighbours(octree.all_cells(*_divided(spark, d)))


_SIDE = "((root >> level) * h)"
OCTIN = {
    "placed": f"SELECT c.*, (ix + 5e-1) * {_SIDE} + ox AS px, (iy + 5e-1) * {_SIDE} + oy AS py, (iz + 5e-1) * {_SIDE} + oz AS cz FROM cells c CROSS JOIN m",
    "box": BOX,
    "ohits": "SELECT level, ix, iy, unnest([minz, maxz]) AS z, unnest([-1, 1]) AS sign FROM (SELECT DISTINCT level, ix, iy, px, py FROM placed) JOIN box ON px > minx AND px < maxx AND py > miny AND py < maxy",
    "kept": "SELECT * FROM (SELECT *, sum(sign) OVER (PARTITION BY level, ix, iy ORDER BY z, sign ROWS UNBOUNDED PRECEDING) AS s FROM ohits) WHERE (s = -1 AND sign < 0) OR (s = 0 AND sign > 0)",
}


@query(_octree_sql() + ", " + ", ".join(f"{k} AS ({v})" for k, v in OCTIN.items()) + " SELECT p.level, p.ix, p.iy, p.iz, p.is_leaf, count(k.z) FILTER (WHERE k.z < p.cz) % 2 = 1 AS inside FROM placed p LEFT JOIN kept k ON k.level = p.level AND k.ix = p.ix AND k.iy = p.iy GROUP BY ALL")
def octree_inside(spark, d):
    divided, lattice = _divided(spark, d)
    return octree.inside(octree.all_cells(divided, lattice), tri(spark, d), lattice)


@query(f"{_octree_sql()} SELECT level, ix, iy, iz, row_number() OVER (ORDER BY level, ix, iy, iz) - 1 AS hex FROM cells WHERE is_leaf")
def octree_numbers(spark, d):
    return octree.numbered(octree.all_cells(*_divided(spark, d)))


_OLO, _OHI = (tuple(f"(i{a} + {s}) * {_SIDE} + o{a}" for a in "xyz") for s in (0, 1))


@query(f"{_octree_sql()} SELECT level, ix, iy, iz, {_corner_sql(_OLO, _OHI)} FROM cells CROSS JOIN m WHERE is_leaf")
def octree_hexes(spark, d):
    divided, lattice = _divided(spark, d)
    g = lattice.grid
    side = f"(shiftright({lattice.root}, level) * {g.h!r}D)"
    at = lambda s: tuple(f"(i{a} + {s}) * {side} + {getattr(g, 'o' + a)!r}D" for a in "xyz")
    return _corner_cols(surface.hexes(octree.all_cells(divided, lattice).where("is_leaf"), at(0), at(1)), "level", "ix", "iy", "iz")


# ---- sampling

R = 6.0


def _thinned(spark, d):
    p = frame(spark, d, "points_evt")
    return p, poisson.thin(p, R)


@query(f"""{sql('points_evt').replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS (SELECT *, {poisson.priority(1)} AS rank FROM points_evt),
e AS (SELECT a.point_id AS a, b.point_id AS b FROM o a JOIN o b ON abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 36 AND (b.rank, b.point_id) < (a.rank, a.point_id)),
s AS (SELECT point_id, 0 AS state, 0 AS turn FROM o UNION ALL
  SELECT s.point_id, CASE WHEN s.state <> 0 THEN s.state WHEN coalesce(bool_or(t.state = 1), false) THEN 2 WHEN coalesce(bool_or(t.state = 0), false) THEN 0 ELSE 1 END, s.turn + 1
  FROM s LEFT JOIN e ON e.a = s.point_id AND s.state = 0 LEFT JOIN s t ON t.point_id = e.b WHERE EXISTS (SELECT 1 FROM s u WHERE u.state = 0) GROUP BY s.point_id, s.state, s.turn)
SELECT point_id FROM s WHERE state = 1 AND turn = (SELECT max(turn) FROM s)""")
def poisson_subset(spark, d):
    return _thinned(spark, d)[1].select("point_id")


@query("SELECT CAST(0 AS BIGINT) AS close, CAST(0 AS BIGINT) AS uncovered")
def poisson_violations(spark, d):
    p, kept = _thinned(spark, d)
    a, b = poisson.too_close(kept, R).agg(F.count("*").alias("close")), poisson.uncovered(p, kept, R).agg(F.count("*").alias("uncovered"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def _scene(spark, d):
    """The box around all meshes, and its longest side."""
    low, high = grids.bounds(frame(spark, d, "vertices"))
    return low, high, max(b - a for a, b in zip(low, high, strict=True))


@query()
def poisson_bridson(spark, d):
    low, high, side = _scene(spark, d)
    return poisson.bridson(spark, low, high, side / 6)


def _dart(n: int, a: str) -> str:
    return f"min(l{a}) + (min(u{a}) - min(l{a})) * (CAST('0x' || substr(md5(concat_ws(':', n, 1, {n})), 1, 13) AS BIGINT) / 4503599627370496e0)"


@query(f"""{sql('vertices').replace('WITH ', 'WITH RECURSIVE ', 1)}, g AS (SELECT {', '.join(f'min({a}) AS l{a}, max({a}) AS u{a}' for a in 'xyz')} FROM vertices),
d AS (SELECT n, {', '.join(f'{_dart(k, a)} AS {a}' for k, a in enumerate('xyz'))} FROM (SELECT unnest(range(60000)) AS n) CROSS JOIN g GROUP BY n),
r AS (SELECT greatest(ux - lx, uy - ly, uz - lz) / 4e0 AS r FROM g),
w AS (SELECT *, n = 0 AS pick FROM d UNION ALL
  SELECT n, x, y, z, n = min(n) OVER () FROM (SELECT w.* FROM w JOIN (SELECT * FROM w WHERE pick) a ON true CROSS JOIN r WHERE NOT w.pick AND (w.x - a.x) ** 2 + (w.y - a.y) ** 2 + (w.z - a.z) ** 2 > r * r)),
k AS (SELECT *, n - lag(n, 1, -1) OVER (ORDER BY n) > 2000 AS late FROM w WHERE pick)
SELECT n AS point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM k WHERE n < coalesce((SELECT min(n) FROM k WHERE late), 60000)""")
def poisson_naive(spark, d):
    low, high, side = _scene(spark, d)
    return _round(poisson.naive(spark, low, high, side / 4), "x", "y", "z")


@query()
def poisson_contour(spark, d):
    """Along the base of each box."""
    base = frame(spark, d, "vertices").where("vertex_id < 4").selectExpr("mesh_id AS polygon_id", "CASE vertex_id WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE vertex_id END AS vertex_no", "x", "y")
    return poisson.contour(base, 0.1)


# ---- scalar functions

NUMS = "SELECT o_orderkey AS n, CAST(o_orderkey % 1024 AS INTEGER) AS i, CAST(o_custkey % 1024 AS INTEGER) AS j, CAST((o_orderkey + o_custkey) % 1024 AS INTEGER) AS k FROM orders"


def _nums(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS n", "CAST(o_orderkey % 1024 AS INT) AS i", "CAST(o_custkey % 1024 AS INT) AS j", "CAST((o_orderkey + o_custkey) % 1024 AS INT) AS k")



@query("WITH t AS (" + NUMS + ") SELECT n, CAST(" + " + ".join(f"(((CAST({v} AS BIGINT) >> {b}) & 1) << {3 * b + a})" for b in range(10) for a, v in enumerate("ijk")) + " AS BIGINT) AS code, i AS di, j AS dj, k AS dk FROM t")
def morton_codes(spark, d):
    coded = _nums(spark, d).selectExpr("n", f"{E.morton('i', 'j', 'k')} AS code")
    return coded.selectExpr("n", "code", *(f"CAST({e} AS INT) AS d{v}" for v, e in zip("ijk", E.morton_decode("code"), strict=True)))


@query("WITH t AS (" + NUMS + ") SELECT n, CAST(CASE WHEN n <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(ltrim(bin(n - 1), '0')) END AS BIGINT) AS up, CAST(CAST(1 AS BIGINT) << length(ltrim(bin(n), '0')) AS BIGINT) AS above, CAST(length(ltrim(bin(n), '0')) AS INTEGER) AS bits, n > 0 AND bit_count(n) = 1 AS pow2 FROM t")
def power_of_two(spark, d):
    return _nums(spark, d).selectExpr("n", f"{E.next_pow2('n')} AS up", f"{E.next_pow2('n', True)} AS above", f"{E.n_bits('n')} AS bits", f"{E.is_pow2('n')} AS pow2")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS sq,
round(sqrt(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 6) AS dist,
round(list_product(list_transform(embedding, lambda x: 1e0 + x::DOUBLE / 64e0)), 6) AS prod,
round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda p: (2e0 * p[1]::DOUBLE + p[2]::DOUBLE) ** 2)), 6) AS mixed FROM embeddings""")
def vector_functions(spark, d):
    from geoweave.functions import vectors as V

    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    a, b = F.slice("e", 1, 32), F.slice("e", 33, 32)
    one = V.plus(V.constant(1.0, 64), V.divided(F.col("e"), 64.0))
    mixed = V.minus(V.scaled(a, 2.0), V.negated(b))
    return e.select("vec_id", F.round(V.sq_length(F.col("e")), 6).alias("sq"), F.round(F.sqrt(V.sq_distance(a, b)), 6).alias("dist"), F.round(V.prod(one), 6).alias("prod"), F.round(V.sq_length(mixed), 6).alias("mixed"))


@query("SELECT s_suppkey, '{' || s_nationkey || '; ' || s_suppkey || '}' AS text, s_name LIKE '%7' AS ends FROM supplier")
def text_functions(spark, d):
    from geoweave.sources.meshes import braces

    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("v", F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey")))
    return s.select("s_suppkey", braces("v").alias("text"), F.col("s_name").endswith("7").alias("ends"))
