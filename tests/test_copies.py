"""Joins by overlap on tables whose rows are many, or copies of one another."""

import re

import pytest

from geoweave.plans.catalog import ORACLES, QUERIES

#: Queries of large sides, none of which may be broadcast for the size of its file.
WIDE = ["box_facet_join", "dist_anti", "knn", "box_count", "box_count_by_row", "box_report", "dist_semi", "point_box_distance", "containing_boxes"]
#: Queries that meet copies once; the points of those beyond WIDE lie at few places.
COPIED = [*WIDE, "nearest_facet", "point_in_tet"]


def tables(spark, d, parts, size, events, suppliers):
    spark.range(parts).selectExpr("id AS p_partkey", f"CAST({size} AS INT) AS p_size").write.parquet(f"{d}/part.parquet")
    spark.range(events).selectExpr("id AS event_id", "id * 7 % 211 AS user_id", "CAST(id * 37 % 61 AS DOUBLE) AS value").write.parquet(f"{d}/events.parquet")
    spark.range(suppliers).selectExpr("id AS s_suppkey", "CAST(id DIV 100 % 2 AS INT) AS s_nationkey").write.parquet(f"{d}/supplier.parquet")
    return d


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("wide")), 60_000, "id", 60_000, 5_000)


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("copied")), 4_000, "1 + id % 3", 2_000, 500)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", WIDE)
def test_no_large_side_is_broadcast(spark, wide, name):
    text = plan(QUERIES[name](spark, wide))
    assert "SortMergeJoin [_level" in text and not re.search(r"BroadcastHashJoin \[_level[^\n]*l__own", text)


@pytest.mark.parametrize("name", COPIED)
def test_copies_meet_once(spark, copied, name):
    import duckdb

    df = QUERIES[name](spark, copied)
    assert "_kind" in plan(df)
    con = duckdb.connect()
    for t in ("part", "events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{copied}/{t}.parquet/*.parquet'")
    cursor = con.execute(ORACLES[name])
    order = [d[0] for d in cursor.description]
    plain = lambda rows: sorted(tuple(-1.5 if v is None else round(v, 5) + 0.0 for v in r) for r in rows)
    assert plain(df.select(*order).collect()) == plain(cursor.fetchall())
