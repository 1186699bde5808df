import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from geoweave.llm import pii


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15],
    }
    spans = [f"{k}:{a}:{b}" for k in pii.BASE for a, b in found[k]]
    return [len(found[k]) for k in pii.BASE], hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


PARTS = ["a", "B", "@", ".", "-", "+", "%", " ", "1", "23", "4111", "😀", "é", "(", ")", "\n", "a@b.c", "255", "256", "001", "4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485", "1.2.3.4"]


def test_against_plain_expressions(spark, odd, empty):
    draw = random.Random(9)
    rows = [(i, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30)))) for i in range(3000)]
    rows += [(-1, "1 " * 50000), (-2, "+1" * 20000), (-3, "1." * 20000), (-4, "4" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).repartition(4)
    found = pii.find(df)
    for r in pii.report(found.withColumn("doc_id", F.monotonically_increasing_id())).join(found.select(F.monotonically_increasing_id().alias("doc_id"), "text"), "doc_id").collect():
        counts, digest, spans = base(r.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest
        assert r.spans.split(",")[: len(spans)] == spans if spans else True
    assert pii.report(pii.find(empty)).count() == 0


def mod97(hit):
    text = hit.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


VALID = {
    "iban": mod97,
    "card_short": lambda h: 13 <= len(re.sub("[^0-9]", "", h)) <= 15 and luhn(re.sub("[^0-9]", "", h)),
    "phone_local": lambda h: True,
}


def added(text):
    """The spans beside the base ones, one hit after the other."""
    taken = [tuple(map(int, s.split(":")[1:])) for s in base(text)[2]]
    out = []
    for kind in pii.ADDED:
        score, context = pii.SCORES[kind]
        hits = list(re.finditer(pii.PATTERNS[kind][0], text))
        for k, m in enumerate(hits):
            if not VALID[kind](m.group()):
                continue
            a, b = m.span()
            lo, hi = hits[k - 2].end() if k > 1 else 0, hits[k + 1].start() if k + 1 < len(hits) else len(text)
            near = text[max(lo, a - pii.REACH) : a] + " " + text[b : min(hi, b + pii.REACH)]
            says = lambda words: bool(re.search(rf"(?ai:(?<![^\W\d_])(?:{words})(?![^\W\d_]))", near))  # noqa: B023, E731
            if score + 0.3 * says(context) - 0.3 * says(pii.AGAINST) >= pii.THRESHOLD - 1e-9 and not any(p < b and a < q for p, q in taken):
                out.append(f"{kind}:{a}:{b}")
    return out


MORE = ["card ", "phone ", " iban ", "order ", "version ", "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "3782 822463 10005", "(415) 555-2671", "415.555.2671", "a@b.c", " x ", "word and word ", "+1 (988) 555-2485", "4111111111111111", " "]


def test_added_spans_one_by_one(spark):
    draw = random.Random(11)
    rows = [(i, "".join(draw.choice(MORE) for _ in range(draw.randint(0, 25)))) for i in range(2000)]
    want = {i: base(t)[2] + added(t) for i, t in rows}
    got = {r.doc_id: [x for x in r.spans.split(",") if x] for r in pii.report(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == want and sum(len(added(t)) for _, t in rows) > 500


def test_masks_one_by_one(spark):
    draw = random.Random(12)
    rows = [(i, "".join(draw.choice(PARTS + MORE) for _ in range(draw.randint(0, 200)))) for i in range(300)]
    df = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in df.withColumn("masked", pii.masked("text", "pii")).collect():
        out, at = "", 0
        for s in sorted(r.pii, key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= at:
                out += r.text[at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.end)
        assert r.masked == out + r.text[at:]


def test_many_hits_of_one_text(spark):
    """A hundred thousand hits take seconds; time that grows with their square would take the better part of an hour."""
    n = 100_000
    df = spark.createDataFrame([(1, "mail ab@cd.ef " * n + "call (415) 555-2671 " * 1000)], "doc_id long, text string")
    start = time.time()
    (row,) = pii.find(df).select(F.size("pii").alias("n"), pii.masked("text", "pii").alias("m")).collect()
    assert row.n == n + 1000 and row.m == "mail <EMAIL> " * n + "call <PHONE_LOCAL> " * 1000
    assert time.time() - start < 60


def test_added_spans_and_masks(spark):
    rows = [
        (1, "my IBAN: GB82 WEST 1234 5698 7654 32 ok", "iban", "my IBAN: <IBAN> ok"),
        (2, "my IBAN: GB83 WEST 1234 5698 7654 32 ok", "", "my IBAN: GB83 WEST 1234 5698 7654 32 ok"),
        (3, "call (415) 555-2671 now", "phone_local", "call <PHONE_LOCAL> now"),
        (4, "part (415) 555-2671 now", "", "part (415) 555-2671 now"),
        (5, "amex card 3782 822463 10005.", "card_short", "amex card <CARD_SHORT>."),
        (6, "x 3782 822463 10005.", "", "x 3782 822463 10005."),
        (8, "(415) 555-2671 is my phone", "phone_local", "<PHONE_LOCAL> is my phone"),
        (9, "phone order (415) 555-2671", "", "phone order (415) 555-2671"),
        (7, "😀 a@b.cd and 1.2.3.4", "email,ip", "😀 <EMAIL> and <IP>"),
    ]
    df = pii.find(spark.createDataFrame(rows, "doc_id long, text string, kinds string, clean string"))
    for r in df.withColumn("masked", pii.masked("text", "pii")).collect():
        assert ",".join(s.kind for s in r.pii) == r.kinds and r.masked == r.clean


def test_very_long_runs_end(spark):
    df = spark.createDataFrame([(1, "a" * 200000), (2, "a." * 100000 + "@"), (3, "1" * 200000), (4, "x@" + "a." * 100000)], "doc_id long, text string")
    assert [r.spans for r in pii.report(pii.find(df)).orderBy("doc_id").collect()][:3] == ["", "", ""]
