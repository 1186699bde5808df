import re

from pyspark.sql import functions as F

from geoweave.llm import mixing


def targets(sizes):
    """By source (None last): plain water-filling."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, budget, out = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        above = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in left}
        for s in above:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
        left -= above
    return out


def check(df):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want = targets(sizes)
    taken, cell = {}, {}
    for r in mixing.mix(df, keep=("source", "text")).collect():
        assert r.size == size(r.text) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        cell[r.source] = cell.get(r.source, 0) + 1
    for s in taken:
        assert abs(taken[s] - want[s]) <= cell[s] and taken[s] <= want[s] + 1e-6


def test_targets(spark, odd, empty):
    check(odd)
    check(spark.createDataFrame([(i, "w " * (i % 17), "abcdefg"[i * i % 7]) for i in range(500)], "doc_id long, text string, source string"))
    check(spark.createDataFrame([(1, "one two three", None)], "doc_id long, text string, source string"))
    assert mixing.mix(empty).count() == 0


def test_reruns_and_repetitions(spark):
    df = spark.createDataFrame([(i, f"w{i} " * (1 + i % 9), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    runs = [sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    rows = mixing.repeated(mixing.mix(df, keep=("text", "source")))
    words = rows.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r.doc_id: r.n for r in words.collect()} == {d: t for d, t in runs[0] if t}
