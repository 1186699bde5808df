import numpy as np

from geoweave.functions import exprs as E
from geoweave.functions import random
from geoweave.operators import mesh, nearest
from geoweave.plans import tools
from geoweave.sources import meshes
from tests.test_geometry import cube


def test_tools(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    meshes.write_mesh(*cube(spark, (1.0, 2.0, 3.0), (2.0, 1.0, 1.0)), at("in.off"))
    tools.convert_mesh(spark, at("in.off"), at("a.stl"))
    tools.normalize_mesh(spark, at("a.stl"), at("b.ply"), extent=4.0, barycenter=True, com=True, repair=True, epsilon=0.01)
    r = mesh.bbox(meshes.read_meshes(spark, at("b.ply"))[0]).first()
    assert (r.minx, r.maxx, r.miny, r.maxy) == (-2.0, 2.0, -1.0, 1.0)
    for kind, how in (("v.mhd", {}), ("v.off", {}), ("v.mesh", {"hexmesh": True}), ("d.mesh", {"dexelize": True}), ("o.mesh", {"octree_": True, "graded": True})):
        tools.voxelize_mesh(spark, at("in.off"), at(kind), num_voxels=8, **how)
    raw = np.frombuffer((tmp_path / "v.raw").read_bytes(), "u1")
    assert len(raw) == 8 * 4 * 4 and set(raw.tolist()) == {255}
    assert "Hexahedra\n128\n" in (tmp_path / "v.mesh").read_text() and "Hexahedra\n32\n" in (tmp_path / "d.mesh").read_text()
    tools.signed_distance(spark, at("in.off"), at("s.mhd"), resolution=0.5)
    field = np.frombuffer((tmp_path / "s.raw").read_bytes(), "<f4").reshape(6, 6, 8)
    assert (field < 0).sum() == 4 * 2 * 2 and abs(field[2, 2, 2] + 0.25) < 1e-6
    tools.signed_distance(spark, at("in.off"), at("t.mhd"), resolution=0.5, voxelize_only=True)
    assert set(np.frombuffer((tmp_path / "t.raw").read_bytes(), "<f4").tolist()) == {-1.0, 1.0}
    tools.poisson_disk(spark, 0.5, at("p.xyz"), k=8)
    assert int((tmp_path / "p.xyz").read_text().split()[0]) >= 4


def test_random_and_order(spark):
    df = random.points(spark, 500, seed=3)
    r = df.selectExpr("min(x) AS a", "max(x) AS b", "avg(y) AS c").first()
    assert 0 <= r.a < 5 and 95 < r.b < 100 and 40 < r.c < 60
    r = spark.range(300).selectExpr(f"{random.uniform_int(2, 4, 'id')} AS n").groupBy().agg({"n": "min"}).first()
    assert r[0] == 2
    tri = mesh.triangles(*cube(spark))
    assert sorted(map(tuple, mesh.clustered(tri).collect())) == sorted(map(tuple, tri.collect()))
    some = df.limit(20).selectExpr("point_id", "x / 20 AS x", "y / 20 AS y", "z / 20 AS z")
    a, b = (sorted((r.point_id, round(r.d2, 9)) for r in f(some, tri).collect()) for f in (nearest.nearest_facet, nearest.nearest_facet_by_all))
    assert a == b
    n = spark.range(60).selectExpr("id", *(f"{e} AS {v}" for v, e in zip("ijk", E.from_linear("id", 3, 4), strict=True)))
    assert n.where(f"{E.linear_index('i', 'j', 'k', 3, 4)} <> id OR NOT {E.valid('i', 'j', 'k', (3, 4, 5))} OR {E.clamped('i + 9', 3)} <> 2").count() == 0
