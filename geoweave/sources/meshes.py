"""Meshes and volumes in files: OFF, OBJ, PLY, STL, Medit (text and binary), XYZ, MetaImage.

Meshes are read through Spark's binary file source, so any store that Spark reads will do, and each file is one row
of work; volumes are read by rows of voxels, so that a file of any size is shared among tasks. Writing streams sorted
partitions through the driver into one file of the store, a partition at a time, as these formats ask for one file;
voxels come as blocks of bytes that executors have made.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESH_EXTENSIONS = ("mesh", "meshb", "obj", "off", "ply", "stl", "xyz")


def extension(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""


def is_mesh(name: str) -> bool:
    """Whether a name's extension is one of a mesh format."""
    return extension(name) in MESH_EXTENSIONS


#: Voxels that a block of a written volume has.
BLOCK = 1 << 20


# ---- parsers: bytes to (vertices, polygons)


def _tokens(data: bytes, comment: str = "#"):
    for line in data.decode("utf-8", "replace").splitlines():
        if words := line.split(comment, 1)[0].split():
            yield words


def parse_off(data: bytes):
    rows = _tokens(data)
    head = next(rows, ["OFF"])
    counts = head[1:] or next(rows, ["0", "0"])
    n, m = int(counts[0]), int(counts[1])
    vertices = [tuple(map(float, next(rows)[:3])) for _ in range(n)]
    return vertices, [tuple(map(int, w[1 : 1 + int(w[0])])) for w in (next(rows) for _ in range(m))]


def parse_obj(data: bytes):
    vertices, polygons = [], []
    for w in _tokens(data):
        if w[0] == "v":
            vertices.append(tuple(map(float, w[1:4])))
        elif w[0] == "f":
            at = [int(x.split("/")[0]) for x in w[1:]]
            polygons.append(tuple(i - 1 if i > 0 else len(vertices) + i for i in at))
    return vertices, polygons


def parse_stl(data: bytes):
    """Corners with equal coordinates become one vertex, numbered as they come."""
    n = struct.unpack_from("<I", data, 80)[0] if len(data) >= 84 else -1
    if len(data) == 84 + 50 * n:
        corners = [struct.unpack_from("<9f", data, 84 + 50 * k + 12) for k in range(n)]
        points = [c[3 * j : 3 * j + 3] for c in corners for j in range(3)]
    else:
        points = [tuple(map(float, w[1:4])) for w in _tokens(data, "\0") if w[0] == "vertex"]
    number: dict = {}
    ids = [number.setdefault(p, len(number)) for p in points]
    return list(number), [tuple(ids[k : k + 3]) for k in range(0, len(ids) - 2, 3)]


PLY_TYPES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


def parse_ply(data: bytes):
    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    kind, elements = "ascii", []
    for w in _tokens(head, "\0"):
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            elements[-1][2].append(w[1:])
    order, at = "<" if "little" in kind else ">", 0
    words = iter(body.split()) if kind == "ascii" else None

    def value(t):
        nonlocal at
        if words is not None:
            return float(next(words)) if t in ("float", "float32", "double", "float64") else int(next(words))
        (x,) = struct.unpack_from(order + PLY_TYPES[t], body, at)
        at += struct.calcsize(PLY_TYPES[t])
        return x

    vertices, polygons = [], []
    for name, n, props in elements:
        for _ in range(n):
            row = {p[-1]: [value(p[2]) for _ in range(int(value(p[1])))] if p[0] == "list" else value(p[0]) for p in props}
            if name == "vertex":
                vertices.append((float(row["x"]), float(row["y"]), float(row["z"])))
            elif name == "face":
                polygons.append(tuple(next(x for x in row.values() if isinstance(x, list))))
    return vertices, polygons


#: Corners of the elements that Medit files name, and the codes of binary ones (fixed values).
MEDIT = {"Vertices": 4, "Triangles": 6, "Quadrilaterals": 7, "Hexahedra": 10, "End": 54}
MEDIT_CORNERS = {"Triangles": 3, "Quadrilaterals": 4, "Hexahedra": 8}


def medit_text(data: bytes) -> dict[str, list[list[float]]]:
    """Elements by name, each as its numbers: coordinates, or corners from 1 on, then a reference."""
    words = [w for row in _tokens(data) for w in row]
    found, at = {}, 0
    while at < len(words):
        name, at = words[at], at + 1
        if name == "End":
            break
        if name in MEDIT:
            n, size = int(words[at]), MEDIT_CORNERS.get(name, 3) + 1
            flat = list(map(float if name == "Vertices" else int, words[at + 1 : at + 1 + n * size]))
            found[name] = [flat[k : k + size] for k in range(0, n * size, size)]
            at += 1 + n * size
    return found


def medit_binary(data: bytes) -> dict[str, list[list[float]]]:
    """The same of a binary file: a 1 that tells the order of bytes, the version (floats from 1 on, doubles from 2,
    long places from 3, long integers from 4), then blocks of a code, the place of the next block, and what it holds."""
    order = "<" if data[:4] == b"\1\0\0\0" else ">"
    _, version = struct.unpack_from(f"{order}2i", data, 0)
    real, whole, place = "f" if version == 1 else "d", "q" if version > 3 else "i", "q" if version > 2 else "i"
    codes, found, at = {v: k for k, v in MEDIT.items()}, {}, 8
    while at:
        (code,) = struct.unpack_from(f"{order}i", data, at)
        (after,) = struct.unpack_from(order + place, data, at + 4)
        name, at = codes.get(code), at + 4 + struct.calcsize(place)
        if name == "End":
            break
        if name:
            (n,) = struct.unpack_from(order + whole, data, at)
            one = struct.Struct(f"{order}3{real}{whole}" if name == "Vertices" else f"{order}{MEDIT_CORNERS[name] + 1}{whole}")
            at += struct.calcsize(whole)
            found[name] = [list(r) for r in one.iter_unpack(data[at : at + n * one.size])]
        at = after
    return found


def _medit_mesh(found):
    return [tuple(v[:3]) for v in found.get("Vertices", [])], [tuple(i - 1 for i in e[:-1]) for name in ("Triangles", "Quadrilaterals") for e in found.get(name, [])]


def parse_medit(data: bytes):
    return _medit_mesh(medit_text(data))


def parse_medit_binary(data: bytes):
    return _medit_mesh(medit_binary(data))


def parse_xyz(data: bytes):
    """Lines of three numbers; a first line of one number is a count."""
    return [tuple(map(float, w[:3])) for w in _tokens(data) if len(w) >= 3], []


PARSERS = {"off": parse_off, "obj": parse_obj, "stl": parse_stl, "ply": parse_ply, "mesh": parse_medit, "meshb": parse_medit_binary, "xyz": parse_xyz}


def read_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, facet_corners) of the files at path (a glob may name many), by extension. mesh_id is a hash of the
    file's path; polygons keep their corners, see mesh.fans for triangles."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for mesh, name, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if extension(name) not in PARSERS:
                    raise ValueError(f"no reader for {name}")
                vertices, polygons = PARSERS[extension(name)](data)
                x, y, z = zip(*vertices, strict=True) if vertices else ((), (), ())
                n, m = len(vertices), len(polygons)
                yield pa.RecordBatch.from_arrays([pa.array([mesh] * (n + m), pa.int64()), pa.array([*range(n), *range(m)], pa.int64()), *(pa.array([*c, *[None] * m], pa.float64()) for c in (x, y, z)), pa.array([None] * n + [list(p) for p in polygons], pa.list_(pa.int64()))], names=["mesh_id", "id", "x", "y", "z", "corners"])

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("mesh_id"), "path", "content")
    rows = files.mapInArrow(work, "mesh_id long, id long, x double, y double, z double, corners array<long>")
    vertices = rows.where("corners IS NULL").selectExpr("mesh_id", "id AS vertex_id", "x", "y", "z")
    corners = rows.where("corners IS NOT NULL").selectExpr("mesh_id", "id AS facet_id", "posexplode(corners) AS (corner_no, vertex_id)")
    return vertices, corners


def read_hexes(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, cell_id, corners: eight points, x fastest; attribute: the element's reference) of Medit files."""
    back = [RING8.index(c) for c in range(8)]

    def work(batches):
        import pyarrow as pa

        point = pa.struct([(a, pa.float64()) for a in "xyz"])
        for batch in batches:
            for mesh, name, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = (medit_binary if extension(name) == "meshb" else medit_text)(data)
                at, cells = found.get("Vertices", []), found.get("Hexahedra", [])
                corners = [[dict(zip("xyz", at[c[k] - 1], strict=False)) for k in back] for c in cells]
                yield pa.RecordBatch.from_arrays([pa.array([mesh] * len(cells), pa.int64()), pa.array(range(len(cells)), pa.int64()), pa.array(corners, pa.list_(point)), pa.array([c[8] for c in cells], pa.int64())], names=["mesh_id", "cell_id", "corners", "attribute"])

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("mesh_id"), "path", "content")
    return files.mapInArrow(work, "mesh_id long, cell_id long, corners array<struct<x:double,y:double,z:double>>, attribute long")


def read_metaimage(spark: SparkSession, header: str, order: str = "ijk") -> DataFrame:
    """(i, j, k, value) of a volume: its header's DimSize, ElementType and ElementDataFile, x fastest. order: which of
    the indexes the file's axes are, the fastest first (kji: files whose last axis is the fastest). The file is split
    by rows of voxels, each with its number."""
    text = "\n".join(r.value for r in spark.read.text(header).collect())  # a header of a few lines
    field = dict(re.findall(r"^(\w+)\s*=\s*(.*?)\s*$", text, re.M))
    nx, ny, nz = map(int, field["DimSize"].split())
    code = {"MET_UCHAR": "u1", "MET_CHAR": "u1", "MET_FLOAT": "<f4", "MET_DOUBLE": "<f8", "MET_SHORT": "<i2", "MET_INT": "<i4"}[field["ElementType"]]
    raw = header.rpartition("/")[0] + "/" + field["ElementDataFile"].rpartition("/")[2]
    if not nx * ny * nz:
        return spark.createDataFrame([], "i int, j int, k int, value double")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            row = np.repeat(batch.column(0).to_numpy(), nx)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), code).astype(np.float64)
            at = [np.tile(np.arange(nx), batch.num_rows), row % ny, row // ny]
            yield pa.RecordBatch.from_arrays([*(pa.array(at[order.index(c)].astype(np.int32)) for c in "ijk"), pa.array(values)], names=["i", "j", "k", "value"])

    # Hadoop's format of records of one length numbers them and splits any file; Spark's own sources hold a file whole
    size = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(nx * int(code[-1]))}
    # fixed-length records are the one thing that DataFrame readers lack here
    rows = spark.sparkContext.newAPIHadoopFile(raw, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=size)
    return spark.createDataFrame(rows.map(lambda r: (r[0], bytearray(r[1]))), "row long, data binary").mapInArrow(work, "i int, j int, k int, value double")


# ---- sinks


class _Out:
    """A file in the store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        self.stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)

    def __enter__(self):
        return lambda data: self.stream.write(bytearray(data))

    def __exit__(self, *_):
        self.stream.close()


def _lines(df: DataFrame, line, key: str):
    """Lines of a frame in the order of key, from sorted ranges, a partition at a time."""
    held = []
    for row in df.select(line).toLocalIterator() if key is None else df.orderBy(key).select(line).toLocalIterator():
        held.append(row[0])
        if len(held) == 10_000:
            yield ("\n".join(held) + "\n").encode()
            held = []
    if held:
        yield ("\n".join(held) + "\n").encode()


def ranked(vertices: DataFrame, facets: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Vertices with n, dense from 0 in the order of vertex_id, and facets with these numbers."""
    from geoweave.operators.mesh import offsets

    numbered = offsets(vertices.withColumn("_one", F.lit(1)), "vertex_id", "_one").withColumnRenamed("offset", "n").drop("_one")
    if facets is None:
        return numbered, None
    for k in range(3):
        facets = facets.join(numbered.select(F.col("vertex_id").alias(f"v{k}"), F.col("n").alias(f"n{k}")), f"v{k}")
    return numbered, facets


def write_mesh(vertices: DataFrame, facets: DataFrame | None, path: str, colour: str | None = None, header: bool = True) -> None:
    """One mesh to one file, by extension (off, obj, ply, stl, mesh, meshb, xyz). colour (off alone): a column of vertices,
    written three times. header (xyz alone): whether the count and the empty last line are written."""
    spark, kind = vertices.sparkSession, extension(path)
    if kind not in MESH_EXTENSIONS:
        raise ValueError(f"no writer for {path}")
    if colour is not None and (kind != "off" or colour not in vertices.columns):
        raise ValueError("a colour needs an .off file and an attribute of that name")
    numbered, facets = ranked(vertices, facets)
    n, m = numbered.count(), facets.count() if facets is not None else 0
    point = F.concat_ws(" ", "x", "y", "z", *([colour] * 3 if colour else []))
    with _Out(spark, path) as put:
        if kind == "meshb":
            zero = F.lit(0).cast("int")
            sections = [("Vertices", n, numbered, [*(F.col(a).cast("double") for a in "xyz"), zero], "n")]
            if facets is not None:
                sections.append(("Triangles", m, facets, [*((F.col(f"n{k}") + 1).cast("int") for k in range(3)), zero], "facet_id"))
            _medit_sections(path, sections, put)
        elif kind == "xyz":
            put(f"{n}\n".encode() if header else b"")
            for part in _lines(numbered, point, "n"):
                put(part)
            put(b"\n" if header else b"")
        elif kind == "stl":
            put(b"\0" * 80 + struct.pack("<I", m))
            corner = {k: numbered.select(F.col("n").alias(f"n{k}"), *(F.col(a).alias(f"t{k}{a}") for a in "xyz")) for k in range(3)}
            for k in range(3):
                facets = facets.join(corner[k], f"n{k}")
            held = bytearray()
            for r in facets.orderBy("facet_id").select(*(f"t{k}{a}" for k in range(3) for a in "xyz")).toLocalIterator():
                held += struct.pack("<12fH", 0, 0, 0, *r, 0)
                if len(held) > 1 << 20:
                    put(held)
                    held = bytearray()
            put(held)
        else:
            head = {"off": f"{'COFF' if colour else 'OFF'}\n{n} {m} 0\n", "obj": "", "ply": f"ply\nformat ascii 1.0\nelement vertex {n}\nproperty double x\nproperty double y\nproperty double z\nelement face {m}\nproperty list uchar int vertex_indices\nend_header\n", "mesh": f"MeshVersionFormatted 2\nDimension 3\nVertices\n{n}\n"}[kind]
            put(head.encode())
            line = {"obj": F.concat(F.lit("v "), point), "mesh": F.concat(point, F.lit(" 0"))}.get(kind, point)
            for part in _lines(numbered, line, "n"):
                put(part)
            if kind == "mesh":
                put(f"Triangles\n{m}\n".encode())
            if facets is not None:
                one = [F.col(f"n{k}") + (1 if kind in ("obj", "mesh") else 0) for k in range(3)]
                line = {"obj": F.concat(F.lit("f "), F.concat_ws(" ", *one)), "mesh": F.concat(F.concat_ws(" ", *one), F.lit(" 0"))}.get(kind, F.concat(F.lit("3 "), F.concat_ws(" ", *one)))
                for part in _lines(facets, line, "facet_id"):
                    put(part)
            if kind == "mesh":
                put(b"End\n")


#: Of the lexicographic corners of a cell those around the bottom and then the top (fixed values).
RING8 = (0, 1, 3, 2, 4, 5, 7, 6)


def _medit_sections(path: str, sections: list[tuple[str, int, DataFrame, list, str]], put) -> None:
    """Sections (name, number of elements, rows, columns of numbers, order) as a text or a binary file (version 3:
    doubles, 32-bit integers, 64-bit places)."""
    if extension(path) == "mesh":
        put(b"MeshVersionFormatted 2\nDimension 3\n")
        for name, n, df, cols, key in sections:
            put(f"{name}\n{n}\n".encode())
            for part in _lines(df, F.concat_ws(" ", *cols), key):
                put(part)
        put(b"End\n")
        return
    at = 8 + 16
    put(struct.pack("<2iiqi", 1, 3, 3, at, 3))  # Dimension 3
    for name, n, df, cols, key in sections:
        one = struct.Struct("<3di" if name == "Vertices" else f"<{len(cols)}i")
        at += 4 + 8 + 4 + n * one.size
        put(struct.pack("<iqi", MEDIT[name], at, n))
        held = bytearray()
        for r in df.orderBy(key).select(*cols).toLocalIterator():
            held += one.pack(*r)
            if len(held) > 1 << 20:
                put(held)
                held = bytearray()
        put(held)
    put(struct.pack("<iq", MEDIT["End"], 0))


def write_hexes(cells: DataFrame, path: str, attribute: str | None = None) -> None:
    """Hexahedra (corners: eight points, x fastest) as a Medit file (.mesh, .meshb); corners at one place are one
    vertex. attribute: a column of whole numbers or truth values that becomes the elements' reference."""
    from geoweave.operators.mesh import offsets

    spark = cells.sparkSession
    if extension(path) not in ("mesh", "meshb"):
        raise ValueError(f"no writer of hexahedra for {path}")
    # the first corner names a cell: cells do not share it
    label = F.col(attribute).cast("int") if attribute else F.lit(0)
    keyed = cells.select(F.col("corners")[0].alias("cell"), "corners", F.coalesce(label, F.lit(0)).alias("label"))
    nodes = cells.select(F.explode("corners").alias("at")).distinct()
    numbered = offsets(nodes.withColumn("_one", F.lit(1)), "at", "_one").withColumnRenamed("offset", "n").select("n", "at")
    parts = keyed.select("cell", "label", F.posexplode("corners").alias("c", "at")).join(numbered, "at").groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"), F.first("label").alias("label"))
    zero = F.lit(0).cast("int")
    with _Out(spark, path) as put:
        _medit_sections(
            path,
            [
                ("Vertices", numbered.count(), numbered, [F.col("at.x"), F.col("at.y"), F.col("at.z"), zero], "n"),
                ("Hexahedra", cells.count(), parts, [*((F.col("m")[c] + 1).cast("int") for c in RING8), F.col("label")], "cell"),
            ],
            put,
        )


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Load a mesh, save it in another format."""
    from geoweave.operators.mesh import fans

    vertices, corners = read_meshes(spark, source)
    facets = fans(corners).withColumn("facet_id", F.expr("facet_id * 1000 + part"))
    write_mesh(vertices, facets, target)


def write_metaimage(cells: DataFrame, grid, path: str, value: str = "value", floating: bool = False, block: int = BLOCK) -> None:
    """A header (.mhd) and a .raw file of one byte (floating: four) for each cell of the grid, x fastest; cells that
    are missing are 0."""
    import numpy as np

    spark, raw = cells.sparkSession, path.removesuffix(".mhd") + ".raw"
    code = "<f4" if floating else "u1"
    fields = ("ObjectType = Image", "NDims = 3", f"DimSize = {grid.nx} {grid.ny} {grid.nz}", f"ElementSpacing = {grid.h} {grid.h} {grid.h}", f"Offset = {grid.ox} {grid.oy} {grid.oz}", f"ElementType = {'MET_FLOAT' if floating else 'MET_UCHAR'}", f"ElementDataFile = {raw.rpartition('/')[2]}")
    with _Out(spark, path) as put:
        put(("\n".join(fields) + "\n").encode())
    # blocks of voxels, as bytes: a block is sorted out in one task, and the driver puts one after the other
    whole = cells.selectExpr(f"(CAST(k AS BIGINT) * {grid.ny} + j) * {grid.nx} + i AS n", f"CAST({value} AS DOUBLE) AS v").withColumn("b", F.expr(f"n DIV {block}"))
    total = grid.nx * grid.ny * grid.nz

    def work(batches):
        import pyarrow as pa

        now, held = None, None
        for batch in batches:
            n, v, b = (batch.column(k).to_numpy() for k in range(3))
            turn = np.flatnonzero(np.diff(b)) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), len(b)], strict=True):
                if lo == hi:
                    continue
                if now != b[lo]:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()], pa.binary())], names=["b", "data"])
                    now = int(b[lo])
                    held = np.zeros(min(block, total - now * block), code)
                held[n[lo:hi] - now * block] = v[lo:hi]
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()], pa.binary())], names=["b", "data"])

    inside = whole.where(f"n >= 0 AND n < {total} AND v IS NOT NULL")
    blocks = inside.repartition("b").sortWithinPartitions("b").mapInArrow(work, "b long, data binary")
    with _Out(spark, raw) as put:
        at, size = 0, np.dtype(code).itemsize
        for r in blocks.orderBy("b").toLocalIterator():
            while at < r.b:  # blocks without cells are zeros
                put(bytes(block * size))
                at += 1
            put(r.data)
            at += 1
        for k in range(at, -(-total // block)):
            put(bytes(min(block, total - k * block) * size))


def braces(array_col: str):
    """{a; b; c}"""
    return F.concat(F.lit("{"), F.array_join(F.transform(array_col, lambda x: x.cast("string")), "; "), F.lit("}"))
