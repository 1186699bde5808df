import struct

import numpy as np
import pytest

from geoweave.operators import grids, mesh
from geoweave.sources import meshes
from tests.test_geometry import cube


@pytest.mark.parametrize("kind", ["off", "obj", "ply", "stl", "mesh", "meshb"])
def test_round_trip(spark, tmp_path, kind):
    v, f = cube(spark, (0.25, 0.5, 1.0), (1.0, 2.0, 0.5))
    v = v.withColumn("vertex_id", v.vertex_id * 10)
    f = f.selectExpr("mesh_id", "facet_id", "v0 * 10 AS v0", "v1 * 10 AS v1", "v2 * 10 AS v2")
    path = str(tmp_path / f"a.{kind}")
    meshes.write_mesh(v, f, path)
    again, corners = meshes.read_meshes(spark, path)
    assert again.count() == 8 and corners.count() == 36
    facets = mesh.fans(corners)
    a, b = mesh.centre_of_mass(mesh.triangles(v, f)).first(), mesh.centre_of_mass(mesh.triangles(again, facets.select("mesh_id", "facet_id", "v0", "v1", "v2"))).first()
    assert a.volume == pytest.approx(b.volume) and a.cz == pytest.approx(b.cz)


def test_convert_colour_and_errors(spark, tmp_path):
    v, f = cube(spark)
    meshes.write_mesh(v.withColumn("heat", v.z), f, str(tmp_path / "c.off"), colour="heat")
    lines = (tmp_path / "c.off").read_text().splitlines()
    assert lines[0] == "COFF" and lines[1] == "8 12 0" and len(lines[2].split()) == 6
    meshes.convert(spark, str(tmp_path / "c.off"), str(tmp_path / "d.stl"))
    assert (tmp_path / "d.stl").stat().st_size == 84 + 50 * 12
    for bad in (lambda: meshes.write_mesh(v, f, str(tmp_path / "x.bin")), lambda: meshes.write_mesh(v, f, str(tmp_path / "x.off"), colour="none"), lambda: meshes.write_mesh(v, f, str(tmp_path / "x.obj"), colour="z")):
        with pytest.raises(ValueError):
            bad()
    assert meshes.is_mesh("a/b.STL") and not meshes.is_mesh("a.stl/b") and not meshes.is_mesh("x.raw")


def test_points(spark, tmp_path):
    v, _ = cube(spark)
    meshes.write_mesh(v, None, str(tmp_path / "p.xyz"))
    text = (tmp_path / "p.xyz").read_text()
    assert text.startswith("8\n") and text.endswith("\n\n")
    assert meshes.read_meshes(spark, str(tmp_path / "p.xyz"))[0].count() == 8


def test_parsers():
    assert meshes.parse_off(b"OFF # c\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n") == ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    assert meshes.parse_obj(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nvn 0 0 1\nf 1//1 2//1 -1//1\n")[1] == [(0, 1, 2)]
    assert meshes.parse_stl(b"solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid\n") == ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    body = struct.pack("<3f", 0, 1, 2) + struct.pack("<3f", 3, 4, 5) + struct.pack("<B3i", 3, 0, 1, 0)
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    assert meshes.parse_ply(head + body) == ([(0, 1, 2), (3, 4, 5)], [(0, 1, 0)])
    assert meshes.parse_medit(b"MeshVersionFormatted 2\nDimension 3\nVertices\n1\n1 2 3 0\nQuadrilaterals\n1\n1 2 3 4 0\nEnd\n") == ([(1, 2, 3)], [(0, 1, 2, 3)])


def test_binary_medit():
    """Both orders of bytes, floats and long integers, and blocks of other kinds between."""
    for order, version, real, whole, place in ((">", 1, "f", "i", "i"), ("<", 2, "d", "i", "i"), ("<", 4, "d", "q", "q")):
        blocks = [(3, struct.pack(f"{order}i", 3)), (4, struct.pack(f"{order}{whole}" + f"3{real}{whole}" * 2, 2, 0, 1, 2, 0, 3, 4, 5, 0)), (5, b"?" * 9), (7, struct.pack(f"{order}{whole}5{whole}", 1, 1, 2, 1, 2, 0))]
        data = struct.pack(f"{order}2i", 1, version)
        for code, body in blocks:
            data += struct.pack(f"{order}i", code) + struct.pack(order + place, len(data) + 4 + struct.calcsize(place) + len(body)) + body
        data += struct.pack(f"{order}i", 54) + struct.pack(order + place, 0)
        assert meshes.parse_medit_binary(data) == ([(0, 1, 2), (3, 4, 5)], [(0, 1, 0, 1)])


@pytest.mark.parametrize("kind", ["mesh", "meshb"])
def test_hexahedra_with_an_attribute(spark, tmp_path, kind):
    from geoweave.operators import surface

    g = grids.Grid(1.0, 2.0, 3.0, 0.5, 3, 3, 3)
    inside = spark.createDataFrame([(0, 0, 0, True), (1, 0, 0, False), (2, 2, 1, None)], "i int, j int, k int, inside boolean")
    cells = surface.voxel_hexes(inside, g)
    path = str(tmp_path / f"h.{kind}")
    meshes.write_hexes(cells, path, attribute="inside")
    got = sorted((tuple(tuple(c) for c in r.corners), r.attribute) for r in meshes.read_hexes(spark, path).collect())
    assert got == sorted((tuple(tuple(c) for c in r.corners), int(bool(r.inside))) for r in cells.collect())
    assert meshes.read_meshes(spark, path)[0].count() == 12 + 8  # two cells share a side


def test_volume_axes_and_blocks(spark, tmp_path):
    g = grids.Grid(0.0, 0.0, 0.0, 1.0, 2, 3, 4)
    rows = [(0, 0, 0, 1.0), (1, 2, 3, 2.0), (0, 1, 2, 3.0), (9, 9, 9, 7.0)]
    for block in (5, 24, 100):
        meshes.write_metaimage(spark.createDataFrame(rows, "i int, j int, k int, value double"), g, str(tmp_path / "b.mhd"), block=block)
        assert (tmp_path / "b.raw").stat().st_size == 24
        assert {(r.i, r.j, r.k, r.value) for r in meshes.read_metaimage(spark, str(tmp_path / "b.mhd")).where("value <> 0").collect()} == set(rows[:3])
        assert {(r.k, r.j, r.i, r.value) for r in meshes.read_metaimage(spark, str(tmp_path / "b.mhd"), "kji").where("value <> 0").collect()} == set(rows[:3])


@pytest.mark.parametrize("floating", [False, True])
def test_volume(spark, tmp_path, floating):
    g = grids.Grid(0.0, 0.0, 0.0, 0.5, 3, 4, 5)
    rows = [(i, j, k, float((i + 2 * j + 3 * k) % 7) - (1.5 if floating else 0)) for i in range(3) for j in range(4) for k in range(5) if (i, j, k) != (1, 1, 1)]
    meshes.write_metaimage(spark.createDataFrame(rows, "i int, j int, k int, value double"), g, str(tmp_path / "v.mhd"), floating=floating)
    got = {(r.i, r.j, r.k): r.value for r in meshes.read_metaimage(spark, str(tmp_path / "v.mhd")).collect()}
    assert got == {(i, j, k): v for i, j, k, v in rows} | {(1, 1, 1): 0.0}
    raw = np.frombuffer((tmp_path / "v.raw").read_bytes(), "<f4" if floating else "u1")
    assert len(raw) == 60 and raw[1] == got[1, 0, 0]


def test_stream(spark, tmp_path):
    from geoweave.operators.ranges import _query_boxes, box_report
    from geoweave.plans.fixtures import frame
    from geoweave.streaming import ranges

    sf = "/root/testdata/sf0.001"
    points, queries = frame(spark, sf, "points_evt"), frame(spark, sf, "queries_part")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    out = ranges.box_report(stream, _query_boxes(queries, "half", "xyz")).select("query_id", "point_id")
    q = out.writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    pair = lambda df: sorted(map(tuple, df.collect()))
    assert pair(spark.table("near")) == pair(box_report(points, queries, "half")) != []
