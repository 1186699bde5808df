"""The command-line tools as functions from files to files, options as keyword arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators import grids, mesh, octree, poisson, rays, sdf, surface
from geoweave.sources import meshes


def load(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles (polygons by fans) of a file; all of its vertices under mesh_id 0."""
    vertices, corners = meshes.read_meshes(spark, source)
    facets = mesh.fans(corners).selectExpr("CAST(0 AS BIGINT) AS mesh_id", "facet_id * 1000 + part AS facet_id", "v0", "v1", "v2")
    return vertices.withColumn("mesh_id", F.lit(0).cast("long")).cache(), facets.cache()


def convert_mesh(spark: SparkSession, source: str, target: str = "out.meshb", color: str | None = None) -> None:
    vertices, facets = load(spark, source)
    meshes.write_mesh(vertices, facets, target, colour=color)


def normalize_mesh(spark: SparkSession, source: str, target: str, extent: float = 1.0, com: bool = False, barycenter: bool = False, repair: bool = False, epsilon: float = 0.0) -> None:
    """epsilon: per cent of the box's diagonal within which vertices become one, if repair is set. barycenter (the
    centre of the box) goes before com."""
    vertices, facets = load(spark, source)
    if repair:
        low, high = grids.bounds(vertices)
        step = epsilon / 100 * sum((b - a) ** 2 for a, b in zip(low, high, strict=True)) ** 0.5 or 1e-12
        to = mesh.weld(vertices, step).select("vertex_id", "target")
        for k in range(3):
            facets = facets.join(to.withColumnsRenamed({"vertex_id": f"v{k}", "target": f"w{k}"}), f"v{k}")
        facets = facets.selectExpr("mesh_id", "facet_id", "w0 AS v0", "w1 AS v1", "w2 AS v2").where("v0 <> v1 AND v1 <> v2 AND v2 <> v0")
        vertices = mesh.isolated(vertices, facets, keep=True)
    origin = "bbox_center" if barycenter else "com" if com else "min"
    meshes.write_mesh(mesh.normalise(vertices, origin, extent, mesh.triangles(vertices, facets)), facets, target)


def voxelize_mesh(spark: SparkSession, source: str, target: str, padding: int = 0, resolution: float = 1.0, num_voxels: int | None = None, hexmesh: bool = False, dexelize: bool = False, octree_: bool = False, graded: bool = False, paired: bool = False) -> None:
    """Dexels or octree leaves as hexahedra, leaves with whether they are inside; voxels as hexahedra (hexmesh), as their boundary (a mesh's extension) or
    as a volume (.mhd)."""
    vertices, facets = load(spark, source)
    tri = mesh.triangles(vertices, facets).cache()
    g = grids.grid_of(vertices, num_voxels, resolution, padding, pow2=octree_ and not dexelize)
    if dexelize:
        meshes.write_hexes(surface.dexel_hexes(rays.spans(rays.dexels(tri, g)), g), target)
    elif octree_:
        lattice, boxes = octree.Lattice(g), mesh.facet_boxes(tri)
        divided = octree.subdivide(lattice, lambda level: octree.overlapped(boxes, lattice, level), spark, graded, paired)
        told = octree.inside(octree.all_cells(divided, lattice), tri, lattice)
        leaves = octree.places(told.where("is_leaf"), lattice)
        meshes.write_hexes(surface.hexes(leaves, ("x", "y", "z"), ("x + side", "y + side", "z + side")), target, attribute="inside")
    else:
        inside = rays.voxelise(tri, g)
        if hexmesh:
            meshes.write_hexes(surface.voxel_hexes(inside, g), target)
        elif meshes.is_mesh(target):
            meshes.write_mesh(*surface.surface(inside.cache(), g), target)
        else:
            meshes.write_metaimage(inside.withColumn("value", F.lit(255)), g, target)


def signed_distance(spark: SparkSession, source: str, target: str, padding: int = 2, resolution: float = 1.0, voxelize_only: bool = False) -> None:
    """A volume of 32-bit floats: distances, negative inside; or 1 and -1 alone."""
    vertices, facets = load(spark, source)
    tri = mesh.triangles(vertices, facets).cache()
    g = grids.grid_of(vertices, None, resolution, padding, up=False)
    field = sdf.signs(tri, g) if voxelize_only else sdf.signed(sdf.unsigned(tri, g), tri, g)
    meshes.write_metaimage(field, g, target, floating=True)


def poisson_disk(spark: SparkSession, min_dist: float, target: str, k: int = 30, seed: int = 1) -> None:
    """Points in the unit cube, more than min_dist apart."""
    out = poisson.bridson(spark, (0.0,) * 3, (1.0,) * 3, min_dist, k, seed)
    meshes.write_mesh(out.selectExpr("CAST(0 AS BIGINT) AS mesh_id", "point_id AS vertex_id", "x", "y", "z"), None, target)


TOOLS = {"convert_mesh": convert_mesh, "normalize_mesh": normalize_mesh, "voxelize_mesh": voxelize_mesh, "signed_distance": signed_distance, "poisson_disk": poisson_disk}
