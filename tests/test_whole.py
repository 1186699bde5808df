"""Queries over whole tables, where a query of the catalogue covers a part alone."""

import pytest

from geoweave.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of a few rows whose ids lie far apart."""
    d = str(tmp_path_factory.mktemp("small"))
    parts = [(k, 1 + k * 7 % 50) for k in (1, 7, 199, 200, 201, 350, 4999, 20000)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{d}/part.parquet")
    events = [(k, k * 13 % 100, float(k * 37 % 61)) for k in range(1, 120)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{d}/events.parquet")
    suppliers = [(k, k % 25) for k in (1, 5, 12, 98, 310)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    return d, parts, events


def test_knn_of_every_part(spark, small):
    d, parts, events = small
    want = set()
    for key, size in parts:
        near = sorted(((v - size) ** 2 + (u - key % 100) ** 2 + (e % 97 - key % 80) ** 2, e) for e, u, v in events)[:5]
        want |= {(key, n, e, round(d2, 6)) for n, (d2, e) in enumerate(near, 1)}
    assert {(r.query_id, r.rank, r.point_id, r.d2) for r in QUERIES["knn"](spark, d).collect()} == want


def test_nearest_box_of_every_point(spark, small):
    from geoweave.plans.fixtures import frame

    d = small[0]
    boxes = {}
    for v in frame(spark, d, "vertices").collect():
        boxes.setdefault(v.mesh_id, []).append((v.x, v.y, v.z))
    want = {}
    for p in frame(spark, d, "probes").collect():
        at, found = (p.x, p.y, p.z), []
        for m, vs in boxes.items():
            lo, hi = [min(c) for c in zip(*vs)], [max(c) for c in zip(*vs)]
            out = [max(a - x, 0, x - b) for x, a, b in zip(at, lo, hi)]
            side = min(min(x - a, b - x) for x, a, b in zip(at, lo, hi))
            found.append((-(side**2) if side >= 0 else sum(o * o for o in out), m, sum((x - (a + b) / 2) ** 2 for x, a, b in zip(at, lo, hi))))
        d2, m, c2 = min(found)
        want[p.point_id] = (m, pytest.approx(d2, abs=1e-5), pytest.approx(c2, abs=1e-5))
    got = {r.point_id: (r.mesh_id, r.d2, r.c2) for r in QUERIES["point_nearest_box"](spark, d).collect()}
    assert len(got) == 8 and got == want


def test_adjacency_of_every_facet(spark, small):
    rows = QUERIES["mesh_adjacency"](spark, small[0]).collect()
    # a closed box of 12 triangles has 18 edges, each between two of them
    assert len(rows) == 5 * 18 and {f for r in rows for f in (r.facet_a, r.facet_b)} == set(range(12))
