import math
import random

import pytest
from pyspark.sql import functions as F

from geoweave.llm import topk


def brute(rows, k, asks):
    good = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if asks(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(df, k):
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, k=k).collect()))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "FAN", 2)
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [(7, rows[7][1]), (10, [0.0] * 4), (300, None), (301, [1.0, None, 0.0, 0.0]), (310, [float("nan"), 0.0, 0.0, 0.0]), (320, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (330, [1.0, 2.0]), (331, [3.0, 4.0]), (340, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    assert run(df, 6) == brute(rows, 6, lambda i: i % 10 == 0)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [float(1 << 40)])], "vec_id long, embedding array<double>")
    assert run(df, 10) == [(0, 1, 2, 1024 * 1024 << 40), (0, 2, 1, 2 << 20)]
    assert run(df.where("vec_id = 0"), 10) == [] and run(df.where("false"), 10) == []


def test_large_components(spark):
    draw = random.Random(5)
    for most in (30, 10**6, 10**9):
        rows = [(i, [float(draw.randint(-most, most)) for _ in range(3)]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, scale=1.0).collect()))
        assert got == sorted((q, n + 1, i, -s) for q, v in rows if q % 10 == 0 for n, (s, i) in enumerate(sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)[:4]))
    df = spark.createDataFrame([(0, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>")
    for scale in (1.0, 1024.0):
        with pytest.raises(Exception, match="does not fit 64 bits"):
            topk.top_k(df, F.col("vec_id") == 0, scale=scale).collect()
