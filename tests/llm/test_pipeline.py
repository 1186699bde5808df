import collections
import glob
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from geoweave.llm import sql
from tests.llm.test_minhash import shingles
from tests.llm.test_pii import added
from tests.llm.test_pii import base as base_spans

sentencepiece = pytest.importorskip("sentencepiece")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == list(P.COLUMNS), name
            assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        kept[name] = out.count()
        docs = out.cache()
    assert kept["language_id"] == 200 and kept["minhash_dedup"] < 200 and kept["pii"] == kept["minhash_dedup"] and kept["sentencepiece"] == kept["mixing"]


def test_odd_rows(spark, odd, empty):
    import corpus_pipeline as P

    for docs in (odd.withColumn("n_chars", F.length("text").cast("long")), empty.withColumn("n_chars", F.lit(0).cast("long"))):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[0] == "doc_id"


def test_each_stage_against_plain_python(spark, tmp_path):
    """Repeated ids with equal and with different texts, rows without id, copies, near copies, personal data, junk."""
    import corpus_pipeline as P

    draw = random.Random(13)
    base = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS).collect() if 200 < len(r.text) < 4000][:90]
    rows = [(r.doc_id, r.text, r.lang if draw.random() < 0.9 else None, r.source, r.n_chars) for r in base]
    for d, t, g, s, n in list(rows):
        kind = draw.randrange(8)
        if kind < 4:
            other = (t, t + " more", t + " mail a@b.cd", draw.choice(base).text)[kind]
            rows.append((draw.choice([d, None, 10**6 + d]), other, g, s, len(other)))
    rows += [(77, "5f4dcc3b5aa765d61d8327deb882cf99 " * 9, None, "junk", 300), (78, "12 34", "en", "junk", 5), (79, None, "en", "junk", None)]
    plain = lambda df: [tuple(r) for r in df.select(*P.COLUMNS).collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS).schema)

    after = plain(P.language(spark, docs, SF))
    good = [r for r in rows if r[3] != "junk"]
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in after) == sorted((r[0] is None, r[0] or 0, r[1]) for r in good)
    told = collections.Counter(r[:3] for r in after)
    assert not collections.Counter(r[:3] for r in good if r[2]) - told and {r[2] for r in after} == {r.lang for r in base}

    # one row of each (id, text) of each group of near copies stays: that of the smallest id, then text hash; no id last
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
    nodes = {}
    for r in after:
        nodes[rank(r)] = min(nodes.get(rank(r), r), r, key=lambda x: key(x[2:]))
    sets = {k: shingles(r[1]) for k, r in nodes.items()}
    top = {k: k for k in nodes}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(sorted(nodes), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    left = [nodes[k] for k in nodes if find(k) == k]
    docs = spark.createDataFrame(after, docs.schema)
    kept = plain(P.near_duplicates(spark, docs, SF))
    assert sorted(kept, key=key) == sorted(left, key=key) and len(left) < len(after)

    def clean(text):
        out, at = "", 0
        for kind, a, b in sorted(((s.split(":")[0], *map(int, s.split(":")[1:])) for s in base_spans(text)[2] + added(text)), key=lambda s: (s[1], s[2], s[0])):
            if a >= at:
                out += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        return out + text[at:]

    docs = spark.createDataFrame(kept, docs.schema)
    masked = plain(P.personal_data(spark, docs, SF))
    assert sorted(masked, key=key) == sorted(((d, clean(t), g, s, len(clean(t))) for d, t, g, s, _ in kept), key=key)
    assert any(t != clean(t) for _, t, *_ in kept)

    import duckdb

    docs = spark.createDataFrame(masked, docs.schema)
    docs.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    taken = {}
    for d, size, words in con.execute(f"SELECT doc_id, size, taken FROM ({sql.MIXING})").fetchall():
        taken.setdefault(d, []).append((size, words))
    mixed = plain(P.mixture(spark, docs, SF))
    words = re.compile(r"[^\x20\x09-\x0D]+")
    got = {}
    for d, t, g, s, n in mixed:
        assert n == len(t)
        whole = [r for r in masked if r[0] == d and (r[1] == t or " ".join(words.findall(r[1])).startswith(t)) and (r[2], r[3]) == (g, s)]
        assert whole
        got[d] = got.get(d, 0) + len(words.findall(t))
    assert got == {d: sum(w for _, w in all_) for d, all_ in taken.items() if sum(w for _, w in all_)}

    docs = spark.createDataFrame(mixed, docs.schema)
    library = sentencepiece.SentencePieceProcessor(model_file=P.tokenizer_path("piece_bpe_32k.model"))
    want = []
    for d, t, *_ in mixed:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((d is None, d or 0, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in P.encoding(spark, docs, SF).collect()) == sorted(want)


def test_run_leaves_no_earlier_stage(spark):
    import corpus_pipeline as P
    from geoweave.llm.common import shared_dir

    rows = P.run(spark, SF).count()
    found = glob.glob(f"{shared_dir(spark).removeprefix('file:')}/geoweave/{spark.sparkContext.applicationId}/pipeline-*")
    assert rows > 100 and len([f for f in found if "mixing" in f]) == len(found)
