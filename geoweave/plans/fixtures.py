"""Geometry derived from the driver's tables by arithmetic that reads the same in Spark and DuckDB.

Each fixture is SQL over tables in braces; frame() runs it in Spark, sql() gives the text for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIV = "CAST(floor({} / {}e0) AS BIGINT)"
#: Two outward triangles a side of a cube whose corner n is at (n % 2, n / 2 % 2, n / 4) (fixed values).
CUBE = ((0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5))
_CORNERS = "(VALUES " + ", ".join(f"({n})" for n in range(8)) + ") AS c(n)"
_FACETS = "(VALUES " + ", ".join(f"({f}, {a}, {b}, {c})" for f, (a, b, c) in enumerate(CUBE)) + ") AS c(f, v0, v1, v2)"
_W = "(1e0 + (s_nationkey % 5) * 25e-2)"

FIXTURES = {
    "points_evt": "SELECT event_id AS point_id, CAST(value AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y, CAST(event_id % 97 AS DOUBLE) AS z FROM {events}",
    "points_li": "SELECT ((l_orderkey * 200003 + l_partkey) * 10007 + l_suppkey) * 8 + l_linenumber AS point_id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount * 1000 AS DOUBLE) AS y, CAST(l_tax * 1000 AS DOUBLE) AS z FROM {lineitem}",
    "queries_part": "SELECT p_partkey AS query_id, CAST(p_size AS DOUBLE) AS qx, CAST(p_partkey % 100 AS DOUBLE) AS qy, CAST(p_partkey % 80 AS DOUBLE) AS qz, CAST(1 + p_partkey % 3 AS DOUBLE) AS half FROM {part}",
    "vertices": f"""SELECT s_suppkey AS mesh_id, CAST(n AS BIGINT) AS vertex_id,
        13e-2 + (s_suppkey % 10) * 3e0 + (n % 2) * {_W} AS x,
        13e-2 + ({DIV.format("s_suppkey", 10)} % 10) * 2e0 + ({DIV.format("n", 2)} % 2) * {_W} AS y,
        13e-2 + {DIV.format("s_suppkey", 100)} * 3e0 + {DIV.format("n", 4)} * (5e-1 + {_W}) AS z
        FROM {{supplier}} CROSS JOIN {_CORNERS}""",
    "facets": f"SELECT s_suppkey AS mesh_id, CAST(f AS BIGINT) AS facet_id, CAST(v0 AS BIGINT) AS v0, CAST(v1 AS BIGINT) AS v1, CAST(v2 AS BIGINT) AS v2 FROM {{supplier}} CROSS JOIN {_FACETS}",
    "tets": f"""SELECT s_suppkey AS cell_id, (s_suppkey % 10) * 3e0 AS t0x, ({DIV.format("s_suppkey", 10)} % 10) * 2e0 AS t0y, 0e0 AS t0z,
        (s_suppkey % 10) * 3e0 + 4e0 AS t1x, ({DIV.format("s_suppkey", 10)} % 10) * 2e0 AS t1y, 0e0 AS t1z,
        (s_suppkey % 10) * 3e0 AS t2x, ({DIV.format("s_suppkey", 10)} % 10) * 2e0 + 4e0 AS t2y, 0e0 AS t2z,
        (s_suppkey % 10) * 3e0 AS t3x, ({DIV.format("s_suppkey", 10)} % 10) * 2e0 AS t3y, 3e0 + s_nationkey % 3 AS t3z FROM {{supplier}}""",
    "segments": f"""SELECT o_orderkey AS segment_id, CAST(o_orderkey % 31 AS DOUBLE) AS px, CAST({DIV.format("o_orderkey", 31)} % 23 AS DOUBLE) AS py, CAST(o_orderkey % 5 AS DOUBLE) - 1e0 AS pz,
        CAST(o_orderkey % 31 + o_custkey % 7 AS DOUBLE) - 25e-1 AS qx, CAST({DIV.format("o_orderkey", 31)} % 23 + o_custkey % 5 AS DOUBLE) - 21e-1 AS qy, CAST(o_custkey % 4 AS DOUBLE) + 1e-1 AS qz FROM {{orders}}""",
    "probes": "SELECT p_partkey AS point_id, (p_size % 30) + 37e-2 AS x, (p_partkey % 21) + 41e-2 AS y, (p_partkey % 7) * 5e-1 + 11e-2 AS z FROM {part}",
}
TRIANGLES = "SELECT f.mesh_id, f.facet_id, " + ", ".join(f"v{k}.{a} AS t{k}{a}" for k in range(3) for a in "xyz") + " FROM facets f " + " ".join(f"JOIN vertices v{k} ON v{k}.mesh_id = f.mesh_id AND v{k}.vertex_id = f.v{k}" for k in range(3))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **used)


def sql(*names: str, **more: str) -> str:
    """WITH clause for DuckDB of the fixtures and of further CTEs by name; triangles needs vertices and facets."""
    parts = []
    for n in names:
        if n == "tri":
            parts += [f"vertices AS ({sql_of('vertices')})", f"facets AS ({sql_of('facets')})", f"tri AS ({TRIANGLES})"]
        else:
            parts.append(f"{n} AS ({sql_of(n)})")
    return "WITH " + ",\n".join([*parts, *(f"{k} AS ({v})" for k, v in more.items())])


def sql_of(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", FIXTURES[name])


def tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoweave.operators.mesh import triangles

    return triangles(frame(spark, sf_dir, "vertices"), frame(spark, sf_dir, "facets"))
