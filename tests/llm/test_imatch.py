import hashlib
import random
import re

import numpy as np

from geoweave.llm import imatch


def lexicon_of(texts):
    df = {}
    for t in texts:
        for w in imatch.terms(t or ""):
            df[w] = df.get(w, 0) + 1
    n, total = len(texts), sum(df.values())
    least = max(imatch.LOWER_SHARE * n, total / imatch.MOST_TERMS, 2)
    return sorted(imatch._hash(w) for w, c in df.items() if least <= c <= max(imatch.UPPER_SHARE * n, least))


def check(spark, df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = imatch.lexicon(df)
    assert found.tolist() == lexicon_of([t for _, t in rows])
    make = imatch.Fingerprints(np.array(found, np.uint64))
    import xxhash

    order = sorted(rows, key=lambda r: (imatch.FIRST_KEY if r[0] is None else r[0], xxhash.xxh3_64_intdigest((r[1] or "").encode()) - (1 << 63)))
    want = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        f, g = make(t), make(edited)
        want.append((-1 if d is None else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, imatch.likeness(f, g), imatch.likeness(f, make(after))))
    got = [(-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in imatch.with_next(df, found).collect()]
    assert sorted(got) == sorted(want)


def test_against_one_pass(spark, odd):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(3)) for _ in range(300)]
    rows = [(draw.randrange(10**6) - 1000, " ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))) for _ in range(400)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    check(spark, odd.select("doc_id", "text"))
    check(spark, odd.where("doc_id = 6").select("doc_id", "text"))


def test_empty(empty):
    found = imatch.lexicon(empty)
    assert imatch.with_next(empty, found).count() == 0 and imatch.fingerprint(empty, found).count() == 0


def test_likeness():
    make = imatch.Fingerprints(np.zeros(0, np.uint64))
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" for i in range(10, 200))
    c = " ".join(f"v{i}" for i in range(200))
    assert make(a) == make(a.upper()) and imatch.likeness(make(a), make(a)) == 1
    assert imatch.likeness(make(a), make(b)) > 0.4 and imatch.likeness(make(a), make(c)) == 0
    assert set(make("").split("-")) == {"."}


def test_fingerprints_against_plain_loops():
    """Each subset holds the terms whose hash, mixed with the subset's odd number, begins with zeros."""
    import xxhash

    mask, draw = (1 << 64) - 1, random.Random(3)
    words = [f"t{i}" for i in range(900)]
    lexicon = np.array(sorted(imatch._hash(w.encode()) for w in words[:600]), np.uint64)
    make = imatch.Fingerprints(lexicon, seed=23)
    odd = [2 * int(x) + 1 & mask for x in np.random.default_rng(23).integers(1, 1 << 63, 32, dtype=np.uint64)]
    for text in ["", "one", "T1 t2, T3.t4; t4", " ".join(draw.sample(words, 300)), " ".join(words[600:]), "x" * 500 + " " + "y" * 80]:
        found = set(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
        within = sorted({imatch._hash(w.encode()) for w in found} & set(lexicon.tolist()))
        if len(within) < 4:
            within = sorted({imatch._hash(w.encode()) for w in found})
        parts = []
        for k in range(32):
            zeros = (2, 4, 6, 8)[k // 8]
            some = []
            for t in within:
                x = (t ^ t >> 29) * odd[k] & mask
                x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & mask
                if x >> 64 - zeros == 0:
                    some.append(t)
            parts.append(f"{xxhash.xxh3_64_intdigest(b''.join(t.to_bytes(8, 'little') for t in some)):016x}" if some else ".")
        assert make(text) == "-".join(parts)
