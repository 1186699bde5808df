"""Meshes as tables: vertices (mesh_id, vertex_id, x, y, z), facets (mesh_id, facet_id, v0, v1, v2) or polygonal
facet_corners (mesh_id, facet_id, corner_no, vertex_id); triangles have flat corners t0x ... t2z. Operators take
key columns, so one mesh or millions of them are handled alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweave.functions import exprs as E

CORNERS = tuple(f"t{k}{a}" for k in range(3) for a in E.AXES)


def triangles(vertices: DataFrame, facets: DataFrame) -> DataFrame:
    """(mesh_id, facet_id, t0x ... t2z): each corner's vertex looked up by key."""
    out = facets
    for k in range(3):
        v = vertices.select("mesh_id", F.col("vertex_id").alias(f"v{k}"), *(F.col(a).alias(f"t{k}{a}") for a in E.AXES))
        out = out.join(v, ["mesh_id", f"v{k}"])
    return out.select("mesh_id", "facet_id", *CORNERS)


def fans(corners: DataFrame) -> DataFrame:
    """Facets (mesh_id, facet_id, v0, v1, v2) of polygons: triangles about corner 0; facet_id counts anew, part is
    the triangle's place in its polygon."""
    w = W.partitionBy("mesh_id", "facet_id").orderBy("corner_no")
    first = F.first("vertex_id").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = corners.withColumns({"v0": first, "v1": F.col("vertex_id"), "v2": F.lead("vertex_id").over(w), "part": F.row_number().over(w) - 2})
    return out.where("part >= 0 AND v2 IS NOT NULL").select("mesh_id", "facet_id", "part", "v0", "v1", "v2")


def facet_boxes(tri: DataFrame) -> DataFrame:
    return E.apply(tri, E.facet_box())


def clustered(tri: DataFrame, bits: int = 16) -> DataFrame:
    """Triangles in ranges of the Morton code of their barycentres, for tables that are read by place. Ids stay."""
    placed = E.apply(tri, E.barycentre())
    low = placed.agg(*(f(f"c{a}") for f in (F.min, F.max) for a in E.AXES)).first()
    if low[0] is None:
        return tri
    span = max(low[3 + k] - low[k] for k in range(3)) or 1.0
    cell = [f"least({(1 << bits) - 1}, CAST(floor((c{a} - {low[k]!r}D) / {span!r}D * {1 << bits}) AS BIGINT))" for k, a in enumerate(E.AXES)]
    parts = int(tri.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = placed.withColumn("_code", F.expr(E.morton(*cell, bits)))
    return keyed.repartitionByRange(parts, "_code").sortWithinPartitions("_code").select(*tri.columns)


def cell_boxes(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Boxes of cells (mesh_id, cell_id, corners: array of vertex ids) of any number of corners."""
    one = cells.select("mesh_id", "cell_id", F.explode("corners").alias("vertex_id")).join(vertices, ["mesh_id", "vertex_id"])
    return one.groupBy("mesh_id", "cell_id").agg(*(f(a).alias(f"{m}{a}") for a in E.AXES for m, f in (("min", F.min), ("max", F.max))))


def bbox(vertices: DataFrame, by: tuple[str, ...] = ("mesh_id",)) -> DataFrame:
    """Box and longest extent."""
    out = vertices.groupBy(*by).agg(*(f(a).alias(f"{m}{a}") for a in E.AXES for m, f in (("min", F.min), ("max", F.max))))
    return out.withColumn("extent", F.expr("greatest(maxx - minx, maxy - miny, maxz - minz)"))


def centre_of_mass(tri: DataFrame, by: tuple[str, ...] = ("mesh_id",)) -> DataFrame:
    """Volume and centre of mass, from tetrahedra with the apex at the origin; null for no volume."""
    six = E.dot(E.vec("t0"), E.cross(E.vec("t1"), E.vec("t2")))
    out = tri.selectExpr(*by, f"{six} / 6e0 AS vol", *(f"(t0{a} + t1{a} + t2{a}) / 4e0 AS m{a}" for a in E.AXES))
    out = out.groupBy(*by).agg(F.sum("vol").alias("volume"), *(F.sum(F.col("vol") * F.col(f"m{a}")).alias(f"s{a}") for a in E.AXES))
    return out.selectExpr(*by, "volume", *(f"s{a} / nullif(volume, 0e0) AS c{a}" for a in E.AXES))


def normalise(vertices: DataFrame, origin: str = "min", extent: float = 1.0, tri: DataFrame | None = None, by: tuple[str, ...] = ("mesh_id",)) -> DataFrame:
    """Vertices moved so that origin ("min": lower corner, "bbox_center", "com") is 0 and the longest extent is extent."""
    box = bbox(vertices, by)
    if origin == "com":
        box = box.join(centre_of_mass(tri, by), list(by))
    at = {"min": "min{a}", "bbox_center": "5e-1 * (min{a} + max{a})", "com": "c{a}"}[origin]
    box = box.selectExpr(*by, "extent", *(f"{at.format(a=a)} AS o{a}" for a in E.AXES))
    met = vertices.join(box, list(by))
    return met.selectExpr(*by, "vertex_id", *(f"CAST({extent!r} AS DOUBLE) * ({a} - o{a}) / nullif(extent, 0e0) AS {a}" for a in E.AXES))


def weld(vertices: DataFrame, eps: float, by: tuple[str, ...] = ("mesh_id",)) -> DataFrame:
    """(mesh_id, vertex_id, target): vertices of one mesh that are linked by steps of at most eps become the one of them
    with the smallest id."""
    from geoweave.operators.boxes import overlap_join, point_boxes
    from geoweave.operators.graph import components

    slim = vertices.select(*by, "vertex_id", *E.AXES)
    around = slim.selectExpr("*", *(f"{a} {sign} {eps!r}D AS {m}{a}" for a in E.AXES for m, sign in (("min", "-"), ("max", "+"))))
    near = f"l_vertex_id < r_vertex_id AND {E.sq_distance(E.vec('l_'), E.vec('r_'))} <= {eps * eps!r}D"
    met = overlap_join(around, point_boxes(slim), residual=near, by=by)
    end = lambda tag: F.struct(*(F.col(f"{tag}{c}").alias(c) for c in (*by, "vertex_id")))
    least = components(met.select(end("l_").alias("a"), end("r_").alias("b")))
    told = least.select(*(F.col(f"node.{c}").alias(c) for c in (*by, "vertex_id")), F.col("least.vertex_id").alias("target"))
    return slim.drop(*E.AXES).join(told, [*by, "vertex_id"], "left").withColumn("target", F.coalesce("target", "vertex_id"))


def isolated(vertices: DataFrame, facets: DataFrame, keep: bool = False) -> DataFrame:
    """Vertices that no facet uses (keep: those that one does)."""
    used = facets.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct()
    return vertices.join(used, ["mesh_id", "vertex_id"], "left_semi" if keep else "left_anti")


def edges(facets: DataFrame) -> DataFrame:
    """(mesh_id, a, b, facets): each edge with the number of facets on it; 1: border, 2: adjacency."""
    pair = "explode(array(named_struct('a', least(v0, v1), 'b', greatest(v0, v1)), named_struct('a', least(v1, v2), 'b', greatest(v1, v2)), named_struct('a', least(v2, v0), 'b', greatest(v2, v0)))) AS e"
    return facets.selectExpr("mesh_id", pair).groupBy("mesh_id", F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count("*").alias("facets"))


def borders(facets: DataFrame) -> DataFrame:
    return edges(facets).where("facets = 1").select("mesh_id", "a", "b")


def adjacency(facets: DataFrame) -> DataFrame:
    """(mesh_id, facet_a, facet_b) of facets that share an edge, a < b."""
    pair = "explode(array(named_struct('a', least(v0, v1), 'b', greatest(v0, v1)), named_struct('a', least(v1, v2), 'b', greatest(v1, v2)), named_struct('a', least(v2, v0), 'b', greatest(v2, v0)))) AS e"
    one = facets.selectExpr("mesh_id", "facet_id", pair).selectExpr("mesh_id", "facet_id", "e.a AS a", "e.b AS b")
    return one.withColumnRenamed("facet_id", "facet_a").join(one.withColumnRenamed("facet_id", "facet_b"), ["mesh_id", "a", "b"]).where("facet_a < facet_b").select("mesh_id", "facet_a", "facet_b").distinct()


def offsets(counts: DataFrame, key: str, n: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exclusive running sum of n in the order of key. Without by, ranges of key are summed first and only the
    ranges' sums are ranked in one place."""
    if by:
        w = W.partitionBy(*by).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
        return counts.withColumn("offset", F.sum(n).over(w) - F.col(n))
    from geoweave.plans.session import cut

    spark = counts.sparkSession
    ranged = cut(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(n).alias("_all"))
    before = sums.withColumn("_before", F.sum("_all").over(W.orderBy("_part")) - F.col("_all")).select("_part", "_before")
    w = W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(before, "_part").withColumn("offset", F.col("_before") + F.sum(n).over(w) - F.col(n)).drop("_part", "_before")
