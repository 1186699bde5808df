import random
import re

from pyspark.sql import functions as F

from geoweave.llm import hosts
from geoweave.llm.queries import RULES, op9_hosts

URLS = {
    1: ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    2: ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    3: ("https://example.org/en/22#t", "example.org", "/en/22", "org/", "allow"),
    4: ("https://notexample.com/de/", "notexample.com", "/de/", "com/de/", "block"),
    5: ("x://com/fr/a://b", "com", "/fr/a://b", "com/fr/", "allow"),
    6: ("http://example.org", "example.org", "", None, "allow"),
    7: ("http://example.org:80/es/", "example.org:80", "/es/", None, "allow"),
    8: (None, "", "", None, "allow"),
    9: ("no scheme/es/", "", "", None, "allow"),
    10: ("", "", "", None, "allow"),
    11: ("http://?q", "", "", None, "allow"),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in URLS.items()], "page_id long, url string, host string").drop("host")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, none, RULES).collect()}
    assert got == {i: u[1:] for i, u in URLS.items()}
    assert hosts.judge(pages.where("false"), none, RULES).count() == 0


def test_reputation(spark):
    """A host with mostly bad pages goes; its neighbour, and a host with one bad page, stay."""
    rows = [(i, f"http://{h}.net/x") for h, at in (("bad.a", 0), ("good.a", 100), ("one.b", 200), ("new.c", 300)) for i in range(at, at + 50)]
    known = [(i, 1 if i % 10 else 0) for i in range(50)] + [(i, 0) for i in range(100, 150)] + [(200, 1), (None, 1), (5, None)]
    known += [(1000 + i, 0) for i in range(100)]
    rows += [(1000 + i, f"http://h{i % 20}.d.net/") for i in range(100)]
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(known, "page_id long, bad int")
    verdicts = {(r.host, r.verdict) for r in hosts.judge(pages, outcomes, []).collect()}
    assert {h for h, v in verdicts if v == "block"} == {"bad.a.net"}
    reputation = {r.name: r for r in hosts.reputations(pages.selectExpr("page_id", "substring_index(substring_index(url, '/', 3), '/', -1) AS host").join(outcomes, "page_id", "left")).collect()}
    assert reputation["one.b.net"].rate < 0.9 and reputation["bad.a.net"].chance > 0.99 and reputation["good.a.net"].rate < reputation["new.c.net"].rate


def test_levels(spark):
    want = {
        "a.b.example.org": ("a.b.example.org", "example.org", "org"),
        "u:p@www.shop.co.in:8080": ("www.shop.co.in", "shop.co.in", "co.in"),
        "x.com.mx.": ("x.com.mx", "x.com.mx", "com.mx"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "10.0.0.1"),
        "[::1]:8080": ("[::1]", "[::1]", "[::1]"),
        "localhost": ("localhost", "localhost", "localhost"),
        "": ("", "", ""),
        "co.uk": ("co.uk", "co.uk", "co.uk"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string").withColumn("name", hosts.name_of(F.col("host")))
    got = {r.host: tuple(r)[1:] for r in df.select("host", "name", *hosts._levels(F.col("name"))).collect()}
    assert got == want


def test_chance(spark):
    """Against a draw from the beta distribution."""
    draw = random.Random(2)
    for a, b in ((1.0, 1.0), (0.5, 9.5), (3.0, 8.0), (40.0, 90.0), (4000.0, 9000.0)):
        got = spark.range(1).selectExpr(f"{a}D AS a", f"{b}D AS b").selectExpr(f"{hosts._chance('a', 'b', 0.25)} AS c").first().c
        assert abs(got - sum(draw.betavariate(a, b) > 0.25 for _ in range(20000)) / 20000) < 0.02


def test_query_blocks_spam_hosts_alone(spark):
    rows = op9_hosts(spark, "/root/testdata/sf0.01").where("rule IS NULL").collect()
    spam = {r.host for r in rows if any(w in hosts.SPAM for w in re.split("[^a-z0-9]+", r.host))}
    assert spam and {r.host for r in rows if r.verdict == "block"} == spam
