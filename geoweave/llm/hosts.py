"""URL filter: rules first, then empirical-Bayes reputation of hosts.

Pages with a known outcome (bad or not) are counted by host, registered domain and suffix. Each level's rate
is shrunk to that of the level above by a beta-binomial prior, whose strength comes from how much more the
rates of that level scatter than chance explains. A host is blocked if the posterior beta distribution gives
its rate of bad pages a chance of at least SURE to be above max_bad, that is if its lower bound is above; the
chance is a ratio of midpoint sums over STEPS parts, which SQL can form too. Hosts without outcomes have their
parents' rate and a wide posterior.

For its levels a host is taken without user, port and final dot. A suffix has two labels if the last one has
two letters and the one before is one of SECOND (co.uk, com.mx), else one; an address, or a host without a
dot, is its own domain and suffix.

Edge cases: a null url, or one without "://", has empty host and path and no rule, and is judged as the host
""; pages without outcome count nowhere; repeated rows count as often as they occur; an empty table gives no
rows; extra columns are ignored. A host that holds most pages is counted in parts before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURE, MAX_BAD, STEPS = 0.95, 0.25, 512
#: Labels that countries register domains under (fixed values).
SECOND = ("ac", "co", "com", "edu", "gov", "net", "or", "org")
#: Words in a host's name that speak of a bad page (fixed values).
SPAM = ("ads", "adult", "bets", "betting", "casino", "gambling", "pills", "poker", "porn", "spam", "viagra", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"^([0-9]+([.][0-9]+){3}|\[.*\])$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty if it is null or has no "://"."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as its text and its verdict; else null."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def name_of(host: Column) -> Column:
    """A host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"[.]?(:[0-9]*)?$", "")


def spam_word(host: Column, words: tuple[str, ...] = SPAM) -> Column:
    """Whether one of the words, between anything but letters and digits, is in a host's name."""
    return F.arrays_overlap(F.split(name_of(host), "[^a-z0-9]+"), F.array(*map(F.lit, words)))


def _levels(name: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    whole = name.rlike(ADDRESS) | ~name.contains(".")
    two = name.rlike(rf"(^|[.])({'|'.join(SECOND)})[.][a-z]{{2}}$")
    suffix = F.when(whole, name).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(whole, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return domain, suffix


def _shrunk(level: DataFrame, mean: str) -> DataFrame:
    """level has n, bad and its parent's rate (mean): with strength (of the prior, one for the level) and rate."""
    m = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(mean)))
    row = level.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(mean), 2) / (m * (1 - m))).alias("q"), F.count("*").alias("g"), F.sum(F.col("n") - 1).alias("free")
    ).first()
    rho = min(0.999, max(1e-3, (row.q - row.g) / row.free)) if row.free else 0.5
    k = 1 / rho - 1
    return level.withColumn("strength", F.lit(float(k))).withColumn("rate", (F.col("bad") + k * F.col(mean)) / (F.col("n") + k))


def _chance(a: str, b: str, above: float) -> str:
    """SQL of the chance that a beta(a, b) is above a value: midpoint sums of its density over its largest value."""
    x, mode = f"((k + 5e-1) / {STEPS}e0)", f"greatest(1e-6, least(999999e-6, CASE WHEN {a} > 1e0 AND {b} > 1e0 THEN ({a} - 1e0) / ({a} + {b} - 2e0) ELSE {a} / ({a} + {b}) END))"
    log = lambda v: f"(({a} - 1e0) * ln({v}) + ({b} - 1e0) * ln(1e0 - {v}))"
    density = f"transform(sequence(0, {STEPS - 1}), k -> named_struct('x', {x}, 'p', exp(least(7e2, {log(x)} - {log(mode)}))))"
    total = "aggregate(d, named_struct('over', 0e0, 'whole', 0e0), (s, y) -> named_struct('over', s.over + CASE WHEN y.x > {0!r}D THEN y.p ELSE 0e0 END, 'whole', s.whole + y.p), s -> CASE WHEN s.whole > 0e0 THEN s.over / s.whole ELSE 0e0 END)".format(above)
    return f"element_at(transform(array({density}), d -> {total}), 1)"


def reputations(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad", sure: float = SURE, max_bad: float = MAX_BAD) -> DataFrame:
    """name, n, bad, rate, chance (of a rate above max_bad) and verdict of each host's name in outcomes (bad: 1, 0 or
    null)."""
    from geoweave.llm.common import stored

    counted = outcomes.groupBy(name_of(F.col(host_col)).alias("name")).agg(F.count(bad_col).alias("n"), F.coalesce(F.sum(F.col(bad_col).cast("long")), F.lit(0)).alias("bad"))
    domain, suffix = _levels(F.col("name"))
    hosts = stored(counted.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrunk(suffixes.withColumn("mean", F.lit(float(top))), "mean").select("suffix", F.col("rate").alias("above"))
    domains = _shrunk(domains.join(suffixes, "suffix"), "above").select("domain", "suffix", F.col("rate").alias("parent"))
    hosts = _shrunk(hosts.join(domains, ["domain", "suffix"]), "parent")
    # the posterior is beta(bad + strength * parent, n - bad + strength * (1 - parent))
    mean = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("parent")))
    hosts = hosts.withColumns({"_a": F.col("bad") + F.col("strength") * mean, "_b": F.col("n") - F.col("bad") + F.col("strength") * (1 - mean)})
    hosts = hosts.withColumn("chance", F.expr(_chance("_a", "_b", max_bad)))
    return hosts.select("name", "n", "bad", "rate", "chance", F.when(F.col("chance") >= sure, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, outcomes: DataFrame | None, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict of every page. outcomes: id and bad (1 or 0) of some pages; without any, a
    page is bad if a rule blocks it or its host's name has a word of SPAM, else not."""
    host, path = split_url(F.col(url_col))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("rule", text).withColumn("by_rule", verdict)
    if outcomes is None:
        told = split.withColumn("bad", (F.coalesce(F.col("by_rule") == "block", F.lit(False)) | spam_word(F.col("host"))).cast("int"))
    else:
        known = outcomes.where(F.col("bad").isNotNull()).groupBy(id_col).agg(F.max("bad").alias("bad"))
        told = split.join(known, id_col, "left")
    by_host = reputations(told.select("host", "bad")).select("name", F.col("verdict").alias("by_host"))
    met = split.withColumn("name", name_of(F.col("host"))).join(by_host, "name", "left")
    return met.select(id_col, "host", "path", "rule", F.coalesce("by_rule", "by_host").alias("verdict"))
