import math
import random

import numpy as np
from pyspark.sql import functions as F

from geoweave.llm import langid, toxicity
from geoweave.llm.grams import WINDOW, Grams
from geoweave.llm.queries import op7_toxicity, op8_langid

SF = "/root/testdata/sf0.1"


def test_grams_are_distinct_and_windows_agree(monkeypatch):
    text = "".join(random.Random(1).choice("abcdeé😀 ") for _ in range(5000))
    whole = Grams((1, 2, 3), 17)(text)
    assert len(whole) == len(set(whole.tolist()))
    monkeypatch.setattr("geoweave.llm.grams.WINDOW", 64)
    assert set(Grams((1, 2, 3), 17)(text).tolist()) == set(whole.tolist())
    assert WINDOW and not len(Grams((3,), 17)(""))


def test_language_held_out(spark):
    rows = op8_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n"), F.min("score"), F.max("score")).first()
    assert held.a > 0.98 and held.n > 2000 and 0 <= held[2] and held[3] <= 1


def test_toxicity_held_out(spark):
    rows = op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("toxic", "score", "predicted").toPandas()
    bad, fine = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (bad.predicted == 1).mean() > 0.7 and (fine.predicted == 1).mean() < 0.01
    wins = np.searchsorted(np.sort(fine.score), bad.score).mean() / len(fine)
    assert wins > 0.95


def test_odd_rows(spark, odd, empty):
    told = {r.doc_id: r for r in langid.predict(odd, langid.train(odd)).collect()}
    assert {d for d, r in told.items() if r.lang_pred == "und"} == {3, 4, 5, 8}
    assert {r.lang_pred for r in told.values()} <= {"und", "en", "de"} and told[3].score == 0
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (6, 1), (9, 0)], "doc_id long, toxic int")
    for held in (labels, labels.where("toxic = 0"), labels.where("false")):
        rows = toxicity.score(odd, toxicity.train(odd, held)).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_picked_ids_are_those_of_smallest_hash(spark):
    """Ids that repeat ever so often, a language that one id fills, and languages with few rows."""
    rows = [("en", i % 700) for i in range(4000)] + [("de", 5)] * 9000 + [("de", i) for i in range(90)] + [("fr", i) for i in range(7)] + [("es", None)]
    order = F.xxhash64("i", F.lit(3))
    known = spark.createDataFrame(rows, "lang string, i long").select("lang", "i", order.alias("o"))
    hashes = {(r.lang, r.i): r.o for r in known.distinct().collect()}
    for per in (5, 60, 300):
        want = {}
        for g in ("en", "de", "fr", "es"):
            ids = sorted((o, i) for (lang, i), o in hashes.items() if lang == g)[:per]
            want |= {(g, i): k for k, (_, i) in enumerate(ids)}
        assert {(r.lang, r.i): r["rank"] for r in langid._picked(known, per).collect()} == want


def test_kernel_and_ridge_against_plain_sums(monkeypatch):
    draw = random.Random(8)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(4))
    texts = [" ".join(word(("abcd", "cdef", "efgh")[i % 3]) for _ in range(12)) for i in range(45)]
    langs = [("x", "y", "z")[i % 3] for i in range(45)]
    monkeypatch.setattr(langid, "LANDMARKS", 6)
    grams = Grams(langid.SIZES, langid.BITS)
    sets = [set(grams(t).tolist()) for t in texts]
    model = langid.fit([grams(t) for t in texts], langs)
    marks = sets[:18]  # six a language, in order
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    value, vector = np.linalg.eigh([[kernel(a, b) for b in marks] for a in marks])
    root = np.array([[vector[i, k] / value[k] ** 0.5 for k in range(18) if value[k] > 1e-6 * value.max()] for i in range(18)])
    rows = np.array([[kernel(a, b) for b in marks] for a in sets]) @ root
    rows = np.hstack([rows, np.ones((45, 1))])
    # the ridge as further rows of a least-squares problem; 15 texts a language weigh 1/15 each
    ridge = langid.RIDGE * 3 / 45
    system = np.vstack([rows / 15**0.5, np.eye(rows.shape[1]) * ridge**0.5])
    asked = [" ".join(word(s) for _ in range(5)) for s in ("abcd", "cdef", "efgh", "dcfe")]
    phi = np.hstack([np.array([[kernel(set(grams(t).tolist()), b) for b in marks] for t in asked]) @ root, np.ones((4, 1))])
    out = []
    for g in "xyz":
        y = np.array([1.0 if h == g else -1.0 for h in langs])
        out.append(phi @ np.linalg.lstsq(system, np.concatenate([y / 15**0.5, np.zeros(rows.shape[1])]), rcond=None)[0])
    out = np.array(out).T
    e = np.exp(langid.SHARP * out)
    for dense in (langid.DENSE, 0):
        monkeypatch.setattr(langid, "DENSE", dense)
        names, scores = langid.Scorer(model)(asked)
        assert names == ["xyz"[k] for k in out.argmax(axis=1)]
        assert np.allclose(scores, (e / e.sum(axis=1, keepdims=True)).max(axis=1), atol=1e-5)


def test_weights_against_plain_counts(monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 40)
    draw = random.Random(9)
    sets = [np.array(sorted({draw.randrange(30) + (25 if k % 3 == 0 else 0) for _ in range(12)}), np.uint32) for k in range(60)]
    labels = np.array([int(k % 3 == 0) for k in range(60)])
    weights, b = toxicity.fit(sets, labels, bits=6)
    ratio, told = {}, {}
    for g in range(64):
        p = sum(y and g in s for s, y in zip(sets, labels))
        q = sum(not y and g in s for s, y in zip(sets, labels))
        if p + q >= 3:
            ratio[g] = math.log(((p + 1) / 22) / ((q + 1) / 42))
            told[g] = sum(n * math.log(n / due) for n, due in ((p, (p + q) / 3), (q, (p + q) * 2 / 3)) if n)
    chosen = sorted((g for g in ratio if ratio[g]), key=lambda g: (-told[g], g))[:40]
    assert set(np.flatnonzero(weights)) <= set(chosen)
    loss = lambda w, c: sum(-math.log(1 / (1 + math.exp(-(1 if y else -1) * (c + sum(w.get(g, 0) * ratio.get(g, 0) for g in s.tolist()))))) / (40 if y else 80) for s, y in zip(sets, labels)) + toxicity.RIDGE / 120 * sum(v * v for v in w.values())
    fitted = {g: float(weights[g]) / ratio[g] for g in chosen}
    # descent without steps that adapt, from the same start
    w, c = dict.fromkeys(chosen, 0.0), 0.0
    for _ in range(1500):
        errors = [((1 / (1 + math.exp(-(c + sum(w[g] * ratio[g] for g in s.tolist() if g in w))))) - y) / (40 if y else 80) for s, y in zip(sets, labels)]
        w = {g: v - 0.5 * (sum(e * ratio[g] for e, s in zip(errors, sets) if g in s) + toxicity.RIDGE / 60 * v) for g, v in w.items()}
        c -= 0.5 * sum(errors)
    assert loss(w, c) - 1e-9 <= loss(fitted, b) <= loss(w, c) + 0.02 < loss({}, 0.0)
