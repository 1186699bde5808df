"""Expressions and operators against independent computations in Python."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.functions import exprs as E
from geoweave.operators import boxes, grids, mesh, nearest, octree, poisson, ranges, rays, surface
from geoweave.plans.fixtures import CUBE


def cube(spark, origin=(0.0, 0.0, 0.0), size=(2.0, 2.0, 2.0), mesh_id=0):
    v = [(mesh_id, n, *(float(o + s * ((n >> a) & 1)) for a, (o, s) in enumerate(zip(origin, size, strict=True)))) for n in range(8)]
    f = [(mesh_id, k, *map(int, t)) for k, t in enumerate(CUBE)]
    return spark.createDataFrame(v, "mesh_id long, vertex_id long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, facet_id long, v0 long, v1 long, v2 long")


def closest(p, a, b, c):
    """Distance by projected search over the triangle: vertices, edges, inside."""
    p, a, b, c = map(np.array, (p, a, b, c))
    best = min(float(((p - q) ** 2).sum()) for q in (a, b, c))
    for u, v in ((a, b), (b, c), (c, a)):
        e = v - u
        if e @ e > 0:
            t = np.clip((p - u) @ e / (e @ e), 0, 1)
            best = min(best, float(((p - u - t * e) ** 2).sum()))
    n = np.cross(b - a, c - a)
    if n @ n > 0:
        m = np.column_stack([b - a, c - a, n])
        s, t, _ = np.linalg.solve(m, p - a)
        if s >= 0 and t >= 0 and s + t <= 1:
            best = min(best, float(((p - a) @ n) ** 2 / (n @ n)))
    return best


def test_triangle_distance(spark):
    draw = random.Random(1)
    rows = [tuple(float(draw.randint(-4, 4)) if draw.random() < 0.5 else draw.uniform(-3, 3) for _ in range(12)) for _ in range(1500)]
    rows += [(1.0, 2.0, 3.0) + (0.0,) * 9, (1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 4.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n}{a} double" for n in ("p", "t0", "t1", "t2") for a in "xyz"))
    for r in E.apply(df, E.triangle_sq()).collect():
        p, a, b, c = (tuple(r[f"{n}{x}"] for x in "xyz") for n in ("p", "t0", "t1", "t2"))
        assert r.d2 == pytest.approx(closest(p, a, b, c), abs=1e-9)


def test_shared_edges_are_hit_once(spark):
    """Columns through the diagonals, sides and corners of a grid of triangles: one hit each."""
    rows = [(i + a[0], j + a[1], 0.0, i + b[0], j + b[1], 0.0, i + c[0], j + c[1], 0.0) for i in range(3) for j in range(3) for a, b, c in (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))]
    tri = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"t{k}{a} double" for k in range(3) for a in "xyz"))
    rays_ = spark.createDataFrame([(x / 2, y / 2) for x in range(1, 6) for y in range(1, 6)], "px double, py double")
    hit = E.apply(tri.crossJoin(rays_), E.column_hit("px", "py")).where("hit").groupBy("px", "py").count()
    assert {r["count"] for r in hit.collect()} == {1} and hit.count() == 25


def test_cube_on_a_grid(spark):
    v, f = cube(spark)
    tri = mesh.triangles(v, f)
    g = grids.Grid(0.0, 0.0, 0.0, 0.5, 4, 4, 4)
    inside = rays.voxelise(tri, g)
    assert inside.count() == 64 and rays.fill_fraction(inside, g).first().fill == 100
    com = mesh.centre_of_mass(tri).first()
    assert com.volume == pytest.approx(8) and com.cx == pytest.approx(1)
    verts, facets = surface.surface(inside, g)
    assert facets.count() == 6 * 16 * 2 and verts.count() == 98
    assert mesh.borders(facets).count() == 0
    out = mesh.centre_of_mass(mesh.triangles(verts, facets)).first()
    assert out.volume == pytest.approx(1)
    assert surface.voxel_hexes(inside, g).selectExpr("min(corners[0].x) AS a", "max(corners[7].z) AS b").first() == (0.0, 2.0)


def test_nested_shells(spark):
    """Three boxes, one within another and one across: 564 voxels wind negative."""
    tri = None
    for n, (o, s) in enumerate((((0.13, 0.07, 0.21), (2.1, 1.9, 1.6)), ((1.03, 0.5, 0.9), (2.2, 1.2, 1.5)), ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)))):
        t = mesh.triangles(*cube(spark, o, s, n))
        tri = t if tri is None else tri.unionByName(t)
    low, high = (0.13, 0.07, 0.21), (3.23, 1.97, 2.4)
    g = grids.Grid.around(low, high, 0.25, 2)
    assert (g.nx, g.ny, g.nz) == (17, 12, 13)
    assert rays.voxelise(tri, g).count() == 564
    spans = rays.spans(rays.dexels(tri, g))
    assert spans.where("z_out <= z_in").count() == 0 and rays.nested_spans(spans).count() > 0


def test_overlap_join_of_all_sizes(spark):
    draw = random.Random(5)
    make = lambda n: [(i, *(x for _ in range(2) for x in (lambda a, s: (a, a + s))(draw.choice([draw.uniform(-9, 9), float(draw.randint(-4, 4))]), draw.choice([0.0, 0.01, 1.0, 2.0, 17.0]))))for i in range(n)]
    schema = "id long, minx double, maxx double, miny double, maxy double"
    a, b = make(150), make(150)
    b += [(900, None, 1.0, 0.0, 1.0), (901, 2.0, 1.0, 0.0, 1.0), (902, float("nan"), 1.0, 0.0, 1.0)]
    met = boxes.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("x", "y"))
    got = sorted((r.l_id, r.r_id) for r in met.collect())
    want = sorted((p[0], q[0]) for p in a for q in b[:-3] if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4])
    assert got == want


def test_overlap_join_of_far_and_tiny_boxes(spark):
    schema = "id long, minx double, maxx double"
    for unit in (1e-12, 1.0, 1e14, 1e200):
        a = [(i, unit * i, unit * (i + 0.5)) for i in range(20)] + [(90, -unit * 5, unit * 50)]
        b = [(i, unit * i, unit * i) for i in range(25)]
        met = boxes.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("x",))
        assert sorted((r.l_id, r.r_id) for r in met.collect()) == sorted([(i, i) for i in range(20)] + [(90, i) for i in range(25)])
    assert boxes.overlap_join(spark.createDataFrame(a, schema).where("false"), spark.createDataFrame(b, schema), ("x",)).count() == 0


def test_range_edges(spark):
    p = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0), (3, None, 0.0, 0.0)], "point_id long, x double, y double, z double")
    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 50.0, 0.0, 0.0)], "query_id long, qx double, qy double, qz double")
    n = lambda pairs: {r.query_id: r.n for r in ranges.counts(q, pairs).collect()}
    assert n(ranges.box_report(p, q, 1.0)) == {1: 1, 2: 0}
    assert n(ranges.sphere_report(p, q, 1.0)) == {1: 0, 2: 0} and n(ranges.sphere_report(p, q, 1.0, closed=True)) == {1: 1, 2: 0}
    assert n(ranges.box_report(p, q, -1.0)) == {1: 0, 2: 0} and n(ranges.sphere_report(p, q, -1.0)) == {1: 0, 2: 0}
    none = p.where("false")
    assert n(ranges.box_report(none, q, 1.0)) == {1: 0, 2: 0} and ranges.knn(none, q, 2).count() == 0
    assert [(r.query_id, r.point_id) for r in ranges.knn(p.where("x IS NOT NULL"), q, 1).orderBy("query_id").collect()] == [(1, 1), (2, 2)]


def test_thinning_is_the_greedy_pass(spark):
    draw = random.Random(8)
    pts = [(i, draw.uniform(0, 1), draw.uniform(0, 1)) for i in range(300)]
    order = lambda i, seed=3: ((((i % 2147483647) * 48271 + seed) % 2147483647 * 69621) % 2147483647, i)
    kept = []
    for i, x, y in sorted(pts, key=lambda p: order(p[0])):
        if all((x - a) ** 2 + (y - b) ** 2 > 0.01 for _, a, b in kept):
            kept.append((i, x, y))
    df = spark.createDataFrame(pts, "point_id long, x double, y double")
    out = poisson.thin(df, 0.1, seed=3, axes=("x", "y"))
    assert sorted(r.point_id for r in out.collect()) == sorted(i for i, _, _ in kept)
    assert poisson.uncovered(df, out, 0.1, ("x", "y")).count() == 0
    seeds = spark.createDataFrame([(0, 0.5, 0.5)], "point_id long, x double, y double")
    assert all((r.x - 0.5) ** 2 + (r.y - 0.5) ** 2 > 0.01 for r in poisson.thin(df, 0.1, seeds=seeds, axes=("x", "y")).collect())


def test_generators(spark):
    low, high = (0.0, 0.0), (1.0, 1.0)
    for made in (poisson.bridson(spark, low, high, 0.2, k=10, domain="x + y < 1.5", axes=("x", "y")), poisson.naive(spark, low, high, 0.25, fails=300, axes=("x", "y"))):
        rows = made.collect()
        assert len(rows) > 5 and len({r.point_id for r in rows}) == len(rows)
        d = min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 for a, b in itertools.combinations(rows, 2)) ** 0.5
        assert d > 0.2 and all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in rows)
    assert poisson.bridson(spark, low, high, 0.2, domain="x > 2", axes=("x", "y")).count() == 0
    square = [(p, n, x + 9.0 * p, y) for p in (0, 1) for n, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    rings = poisson.contour(spark.createDataFrame(square, "polygon_id long, vertex_no int, x double, y double"), 0.1).collect()
    for p in (0, 1):
        ring = [(r.x - 9 * p, r.y) for r in sorted(rings, key=lambda r: r.point_id) if r.polygon_id == p]
        assert all(math.dist(a, b) > 0.1 for a, b in itertools.combinations(ring, 2))
        assert all(min(abs(x), abs(x - 1), abs(y), abs(y - 1)) < 1e-9 for x, y in ring)
        # along a side the next point is at most twice the distance away, unless draws fail near another side's points
        assert 20 <= len(ring) <= 40
        for k in range(400):
            at = (k % 100 / 100, 0.0) if k < 100 else (1.0, k % 100 / 100) if k < 200 else (k % 100 / 100, 1.0) if k < 300 else (0.0, k % 100 / 100)
            assert min(math.dist(at, q) for q in ring) <= 0.21


def drawn(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def test_naive_is_one_dart_after_the_other(spark):
    kept, n, misses = [], 0, 0
    while misses < 150:
        p = (drawn(n, 4, 0), 2 * drawn(n, 4, 1))
        if all((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 > 0.04 for _, q in kept):
            kept.append((n, p))
            misses = -1
        n, misses = n + 1, misses + 1
    out = poisson.naive(spark, (0.0, 0.0), (1.0, 2.0), 0.2, seed=4, fails=150, axes=("x", "y"))
    assert {r.point_id: (r.x, r.y) for r in out.collect()} == {n: pytest.approx(p) for n, p in kept}


def test_waves_are_one_candidate_after_the_other(spark):
    """Candidates of a wave in the order of their priority, each held against all accepted before it."""
    r, k, seed = 0.3, 6, 2
    inside = lambda p: 0 <= p[0] <= 1 and 0 <= p[1] <= 1
    first = (drawn(0, seed, 0), drawn(0, seed, 1))
    done, active, wave, number = {0: first}, {0: first}, 1, 1
    while active:
        fresh = {}
        for o in sorted(active):
            for t in range(k):
                for trial in range(40):
                    u = [2 * drawn(o, t, trial, seed, wave, n) - 1 for n in (0, 1)]
                    far = r * (1 + drawn(o, t, trial, seed, wave, 9))
                    p = tuple(c + x / math.hypot(*u) * far for c, x in zip(active[o], u))
                    if inside(p):
                        fresh[number], number = p, number + 1
                        break
        order = lambda i: ((((i % 2147483647) * 48271 + seed + wave) % 2147483647 * 69621) % 2147483647, i)  # noqa: B023, E731
        active = {}
        for i in sorted(fresh, key=order):
            if all(math.dist(fresh[i], q) > r for q in [*done.values(), *active.values()]):
                active[i] = fresh[i]
        done |= active
        wave += 1
    out = poisson.bridson(spark, (0.0, 0.0), (1.0, 1.0), r, k, seed, axes=("x", "y"), trials=40)
    assert {p.point_id: (p.x, p.y) for p in out.collect()} == {i: pytest.approx(p) for i, p in done.items()}


def test_octree_sweep_is_the_recursive_rule(spark):
    """Random subdivisions, against splitting one cell after the other under the same rules."""
    draw = random.Random(4)
    for graded, paired in itertools.product((False, True), repeat=2):
        lattice = octree.Lattice(grids.Grid(0.0, 0.0, 0.0, 1.0, 16, 8, 8))
        roots, depth = lattice.roots, lattice.depth
        wanted = [{(draw.randrange(roots[0] << lv), draw.randrange(roots[1] << lv), draw.randrange(roots[2] << lv)) for _ in range(2)} if lv else set() for lv in range(depth)]
        for lv in range(depth - 1, 0, -1):
            wanted[lv - 1] |= {tuple(x // 2 for x in c) for c in wanted[lv]}
        split = set()

        def divide(lv, c):
            if (lv, c) in split:
                return
            if lv:
                divide(lv - 1, tuple(x // 2 for x in c))
            split.add((lv, c))
            if paired:
                group = itertools.product(*((x // 2 * 2, x // 2 * 2 + 1) for x in c)) if lv else itertools.product(*map(range, roots))
                for s in group:
                    divide(lv, s)
            if graded and lv:
                for d in octree.NEAR:
                    n = tuple(x + y for x, y in zip(c, d, strict=True))
                    if all(0 <= x < r << lv for x, r in zip(n, roots, strict=True)):
                        divide(lv - 1, tuple(x // 2 for x in n))

        for lv in range(depth):
            for c in wanted[lv]:
                divide(lv, c)
        schema = "level int, ix int, iy int, iz int"
        out = octree.subdivide(lattice, lambda lv: spark.createDataFrame([(lv, *c) for c in wanted[lv]], schema), spark, graded, paired)
        assert {(r.level, (r.ix, r.iy, r.iz)) for r in out.collect()} == split
        cells = octree.all_cells(out, lattice)
        if graded:
            assert octree.ungraded(cells, lattice).count() == 0
        if paired:
            assert octree.unpaired(cells).count() == 0
        volume = cells.where("is_leaf").agg(F.sum(F.expr("power(8D, -level)")).alias("v")).first().v
        assert volume == pytest.approx(roots[0] * roots[1] * roots[2])


def test_segments(spark):
    tri = mesh.triangles(*cube(spark))
    rows = [(1, -1.0, 0.9, 0.3, 3.0, 0.9, 0.3), (2, -1.0, 5.0, 0.3, 3.0, 5.0, 0.3), (3, 0.5, 0.9, 0.3, 1.0, 0.9, 0.4)]
    s = spark.createDataFrame(rows, "segment_id long, px double, py double, pz double, qx double, qy double, qz double")
    assert [r.segment_id for r in nearest.segment_any(s, tri).collect()] == [1]
    (r,) = nearest.segment_nearest(s, tri).collect()
    assert (r.segment_id, r.param) == (1, pytest.approx(0.25)) and nearest.segment_hits(s, tri).count() == 2


def test_offsets_without_keys(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "k long, n long")
    total = 0
    for r in mesh.offsets(df, "k", "n").orderBy("k").collect():
        assert r.offset == total
        total += r.n


def test_fans_and_cells(spark):
    corners = spark.createDataFrame([(0, 0, i, i + 10) for i in range(5)] + [(0, 1, 0, 1), (0, 1, 1, 2)], "mesh_id long, facet_id long, corner_no int, vertex_id long")
    assert sorted((r.facet_id, r.part, r.v0, r.v1, r.v2) for r in mesh.fans(corners).collect()) == [(0, k, 10, 11 + k, 12 + k) for k in range(3)]
    v, _ = cube(spark)
    cells = spark.createDataFrame([(0, 5, [0, 3, 6])], "mesh_id long, cell_id long, corners array<long>")
    r = mesh.cell_boxes(cells, v).first()
    assert (r.minx, r.maxx, r.minz, r.maxz) == (0.0, 2.0, 0.0, 2.0)
    faces = surface.hex_faces(spark.createDataFrame([(0, *range(8)), (1, 1, 20, 3, 21, 5, 22, 7, 23)], "cell_id long, " + ", ".join(f"n{k} long" for k in range(8))))
    assert faces.where("cells = 2").count() == 1 and faces.where("cells = 1").count() == 10


def test_weld_goes_by_distance(spark):
    """Across the borders of any grid, along chains, and within a mesh alone."""
    draw = random.Random(6)
    rows = [(m, i, *(round(draw.uniform(0, 4), 3) for _ in range(3))) for m in (0, 1) for i in range(150)]
    top = {(m, i): i for m, i, *_ in rows}

    def find(m, i):
        while top[m, i] != i:
            i = top[m, i]
        return i

    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and math.dist(a[2:], b[2:]) <= 0.35:
            x, y = find(a[0], a[1]), find(b[0], b[1])
            top[a[0], max(x, y)] = min(x, y)
    out = mesh.weld(spark.createDataFrame(rows, "mesh_id long, vertex_id long, x double, y double, z double"), 0.35)
    assert {(r.mesh_id, r.vertex_id): r.target for r in out.collect()} == {(m, i): find(m, i) for m, i, *_ in rows}


def test_long_segments_and_mixed_sizes(spark):
    """Segments across everything, short ones and points, against facets of very different sizes."""
    draw = random.Random(15)
    spot = lambda s: tuple(draw.uniform(-s, s) for _ in range(3))
    facets = [(f // 7, f % 7, *(x for _ in range(3) for x in (a + b for a, b in zip(at, spot(size))))) for f in range(120) for at, size in [(spot(10), draw.choice([0.1, 1.0, 8.0]))]]
    tri = spark.createDataFrame(facets, "mesh_id long, facet_id long, " + ", ".join(f"{c} double" for c in mesh.CORNERS))
    segs = [(i, *spot(12), *spot(12)) for i in range(60)] + [(60 + i, *p, *(x + d for x, d in zip(p, spot(0.5)))) for i in range(60) for p in [spot(10)]] + [(200, *spot(3)) * 1 + spot(0)] 
    s = spark.createDataFrame(segs, "segment_id long, px double, py double, pz double, qx double, qy double, qz double")

    def det(a, b, c):
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])

    want = {}
    for i, *c in segs:
        p, q = c[:3], c[3:]
        for m, f, *t in facets:
            t0, t1, t2 = t[:3], t[3:6], t[6:]
            d, e, g, o = ([a - b for a, b in zip(x, y)] for x, y in ((p, q), (t1, t0), (t2, t0), (p, t0)))
            whole = det(d, e, g)
            if whole:
                w, u, v = det(o, e, g) / whole, det(d, o, g) / whole, det(d, e, o) / whole
                if 0 <= w <= 1 and u > 0 and v > 0 and u + v < 1:
                    want.setdefault(i, []).append((w, m, f))
    hits = {}
    for r in nearest.segment_hits(s, tri).collect():
        hits.setdefault(r.segment_id, []).append((pytest.approx(r.param), r.mesh_id, r.facet_id))
    assert {i: len(h) for i, h in hits.items()} == {i: len(h) for i, h in want.items()} and len(want) > 30
    first = {r.segment_id: (r.param, r.mesh_id, r.facet_id) for r in nearest.segment_nearest(s, tri).collect()}
    assert first == {i: (pytest.approx(min(h)[0]), *min(h)[1:]) for i, h in want.items()}
    assert {r.segment_id for r in nearest.segment_any(s, tri).collect()} == set(want)


def test_nearest_places_and_neighbours(spark):
    """Clusters, far points and few targets; places lie on their facets at the distance told."""
    draw = random.Random(16)
    near = lambda c, s: tuple(x + draw.gauss(0, s) for x in c)
    centres = [(0.0, 0.0, 0.0), (50.0, 3.0, -2.0), (50.2, 3.0, -2.0)]
    facets = [(0, f, *(x for _ in range(3) for x in near(centres[f % 3], (2.0, 0.01, 1.0)[f % 3]))) for f in range(90)]
    tri = spark.createDataFrame(facets, "mesh_id long, facet_id long, " + ", ".join(f"{c} double" for c in mesh.CORNERS))
    spots = [(i, *near(centres[i % 3], (3.0, 0.02, 40.0)[i % 3])) for i in range(150)] + [(500, 1e6, -1e6, 3.0), (501, None, 0.0, 0.0)]
    points = spark.createDataFrame(spots, "point_id long, x double, y double, z double")
    want = {r.point_id: r for r in nearest.nearest_facet_by_all(points.where("x IS NOT NULL"), tri).collect()}
    for some in (tri, tri.where("facet_id = 4")):
        want = {r.point_id: r for r in nearest.nearest_facet_by_all(points.where("x IS NOT NULL"), some).collect()}
        got = {r.point_id: r for r in nearest.nearest_facet(points, some, place=True).collect()}
        assert {i: (r.facet_id, r.d2) for i, r in got.items()} == {i: (r.facet_id, pytest.approx(r.d2)) for i, r in want.items()}
        for i, *p in spots[:150]:
            assert math.dist(p, (got[i].nx, got[i].ny, got[i].nz)) ** 2 == pytest.approx(got[i].d2, abs=1e-9)
    q = points.where("x IS NOT NULL").selectExpr("point_id AS query_id", "x AS qx", "y AS qy", "z AS qz")
    data = points.where("x IS NOT NULL AND point_id < 100")
    for k in (1, 4, 200):
        got = {}
        for r in ranges.knn(data, q, k).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.point_id))
        for i, *p in spots[:-1]:
            order = sorted((sum((a - b) ** 2 for a, b in zip(c, p)), j) for j, *c in spots[:100])[:k]
            assert sorted(got[i]) == [(n, j) for n, (_, j) in enumerate(order, 1)]


def test_powers_and_bits_of_large_numbers(spark):
    for x in (0, 1, 2, 3, 1 << 30, (1 << 30) + 1, (1 << 39) + 5, 1 << 61, (1 << 61) - 1):
        r = spark.range(1).selectExpr(f"CAST({x} AS BIGINT) AS x").selectExpr(f"{E.next_pow2('x')} AS a", f"{E.next_pow2('x', True)} AS b", f"{E.n_bits('x')} AS n").first()
        assert tuple(r) == (1 << max(0, (x - 1).bit_length()) if x else 1, 1 << x.bit_length(), x.bit_length())


def test_octree_stops_at_a_number_of_cells(spark):
    lattice = octree.Lattice(grids.Grid(0.0, 0.0, 0.0, 1.0, 16, 16, 16))
    box = spark.createDataFrame([(3.1, 3.2, 3.1, 3.2, 3.1, 3.2)], "minx double, maxx double, miny double, maxy double, minz double, maxz double")
    for most, levels in ((None, 4), (33, 4), (32, 3), (9, 1), (8, 0)):
        cells = octree.all_cells(octree.subdivide(lattice, lambda level: octree.overlapped(box, lattice, level), spark, max_cells=most), lattice)
        assert (cells.count(), cells.agg(F.max("level")).first()[0]) == (1 + 8 * levels, levels)
