"""What single stages of the pipeline drop and keep."""

import base64
import hashlib
import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
FOREIGN = [
    "Все люди рождаются свободными и равными в своём достоинстве и правах.",
    "人人生而自由，在尊严和权利上一律平等。",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
]
SHORT = ["The in of.", "Un de la que", "Und der", "Les de un", "On that, in the."]


def test_language_rejects_foreign_and_junk(spark):
    import corpus_pipeline as P

    draw = random.Random(3)
    junk = [
        hashlib.sha512(b"x").hexdigest(),
        base64.b64encode(draw.randbytes(300)).decode(),
        " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9))) for _ in range(60)),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    planted = [(10**6 + k, t, None, "p", len(t)) for k, t in enumerate(FOREIGN + junk + SHORT)]
    out = P.language(spark, docs.unionByName(spark.createDataFrame(planted, docs.schema)), SF)
    assert out.where(F.col("doc_id") < 10**6).count() == docs.count()
    assert {r.text for r in out.where(F.col("doc_id") >= 10**6).collect()} == set(SHORT)


def test_dedup_goes_by_id_and_text(spark):
    import corpus_pipeline as P

    draw = random.Random(5)
    a, b, c, d = (" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(4))
    rows = [
        (1, a, "en"),
        (2, a + " more", "en"),  # a near copy
        (2, b, "en"),  # of the same id, a copy of nothing
        (3, c, "en"),
        (3, c, "de"),  # a row that repeats
        (None, d, "en"),
        (None, d, "en"),
        (None, d + " more", "en"),
        (None, a, "en"),  # a copy of a row with an id
        (None, None, "en"),
    ]
    schema = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS).schema
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], schema)
    got = [(r.doc_id, r.text, r.lang) for r in P.near_duplicates(spark, docs, SF).collect()]
    first = min((d, d + " more"), key=lambda t: hashlib.md5(t.encode()).digest())
    assert sorted(got, key=str) == sorted([(1, a, "en"), (2, b, "en"), (3, c, "de"), (None, first, "en"), (None, None, "en")], key=str)
