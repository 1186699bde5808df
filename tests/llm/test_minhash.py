import random
import re
import tracemalloc

import numpy as np

from geoweave.llm import minhash
from geoweave.llm.minhash import components, near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent):
    sets = [(d, shingles(t)) for d, t in rows]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (p, a) in enumerate(sets):
        for j, (q, b) in enumerate(sets[:i]):
            if p is not None and q is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets) if d is not None))


def got(df, percent):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, percent=percent).collect() if r.doc_id is not None)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(80)]
    for family in range(12):
        base = [word() for _ in range(draw.choice([3, 8, 60, 200, 500]))]
        for _ in range(draw.choice([1, 3, 40])):
            text = list(base)
            for _ in range(draw.randint(0, 1 + len(base) // 60)):
                text[draw.randrange(len(text))] = word()
            if family % 3 == 0:
                text += passage
            rows.append((len(rows) * 3 % 1009, " ".join(text).title() if draw.random() < 0.3 else " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (80, 85):
        assert got(df, percent) == brute(rows, percent)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd, 85) == brute(rows, 85)
    alone = [r for r in near_duplicates(odd).collect() if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in alone] == [(None, True)]
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 520)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    found = {r.node: r.top for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found.get(n, n) == find(n) for n in list(top))


def test_a_block_of_near_copies_is_small():
    family = np.arange(200, dtype="<u4") * 1000
    rows = []
    for k in range(1024):
        own = family.copy()
        own[k % 200] += k + 1
        rows.append((0, k.to_bytes(16, "big"), 200, np.unique(own).tobytes(), [0], None))
    tracemalloc.start()
    pairs = minhash._block_pairs(0, rows, 80, False, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 1023 and all(certain for *_, certain in pairs)
    assert most < 80e6


def test_wide_lists_start_no_other_workers(spark, monkeypatch):
    """An empty list of Python's among the links would run in workers of its own kind on each executor."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    made = []
    real = type(spark).createDataFrame
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten w{i}") for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: made.append(a) or real(self, *a, **b))
    rows = near_duplicates(docs, percent=70).collect()
    assert {r.component_id for r in rows} == {0} and not made
