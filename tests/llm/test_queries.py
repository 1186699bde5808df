"""Every registered query of these operators on written tables of odd rows and on empty ones."""

import pytest

from geoweave.llm.queries import QUERIES
from tests.llm.conftest import ODD, SCHEMA

KEPT = {n for n in QUERIES if n not in ("op5_packing", "op6_topk", "op9_hosts")}
MORE = [
    (11, "one id", "en", "a", None),
    (11, "one id has a second text", "fr", None, None),
    (12, "mail a@b.cd " * 3000, "en", "a", None),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of odd tables and one of empty ones; each table has columns that clash with the operators' own."""
    odd, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    rows = {
        "documents": (ODD + MORE, SCHEMA + ", score double, rule string, id long", (0.5, "x", 7)),
        "labels": ([(1, 1, 1), (1, 0, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (6, 1, 1), (9, 0, 0), (11, 1, 1)], "doc_id long, quality int, toxic int, text string", ("y",)),
        "pages": ([(1, "http://a.spam-b.com/de/"), (1, "http://a.spam-b.com/de/"), (None, "http://x.org"), (2, None), (3, "://"), (4, "http://1.2.3.4:80/en/")], "page_id long, url string, host string, n long", ("h", 3)),
        "embeddings": ([(0, [1.0, 2.0]), (100, [0.5, 0.25]), (1, [3.0, 4.0]), (None, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (200, []), (1, [3.0, 4.0])], "vec_id long, embedding array<float>, score long, shard int", (1, 2)),
    }
    for name, (data, schema, more) in rows.items():
        df = spark.createDataFrame([(*r, *more) for r in data], schema)
        df.write.parquet(f"{odd}/{name}.parquet")
        df.where("false").write.parquet(f"{empty}/{name}.parquet")
    return odd, empty


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, tables, name):
    rows = QUERIES[name](spark, tables[0]).collect()
    if name in KEPT:
        want = [r[0] for r in ODD + MORE]
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i for i in want if i is not None)
        assert sum(r.doc_id is None for r in rows) == sum(i is None for i in want)
    if name == "op9_hosts":
        assert len(rows) == 6 and {r.verdict for r in rows} <= {"allow", "block"}
    if name == "op6_topk":
        assert {(r.query_id, r.rank, r.vec_id) for r in rows} == {(0, 1, 1), (0, 2, 1), (0, 3, 100), (100, 1, 1), (100, 2, 1), (100, 3, 0)}
    assert QUERIES[name](spark, tables[1]).count() == 0
