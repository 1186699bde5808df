"""The queries that SQL can express, as DuckDB has them: plain joins over all pairs, recursion, closed forms."""

from __future__ import annotations

from geoweave.llm.hosts import LOWER, MAX_BAD, SECOND, SPAM, STEPS, SURE, UPPER

WORDS = r"'[^\x20\x09-\x0D]+'"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM e p JOIN e q USING (g) WHERE p.doc_id < q.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, k.b FROM r JOIN k ON k.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size,
             CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2e0 * source_size / weight, source NULLS LAST) AS k FROM s),
f AS (SELECT k, weight, 2 * source_size AS cap,
        (15e-1 * CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - CAST(coalesce(sum(2 * source_size) OVER b, 0) AS DOUBLE)) / CAST((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT level FROM f WHERE level * weight <= cap ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * coalesce((SELECT level FROM t), 0e0)) AS target FROM s),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
q AS (SELECT *, target - whole * source_size AS want FROM p),
x AS (SELECT d.*, q.source_size, q.target, q.whole, q.want, h >> 30 AS c1, (h >> 20) & 1023 AS c2 FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
a AS (SELECT source, c1, want, CAST(sum(size) AS BIGINT) AS words FROM x GROUP BY ALL),
b AS (SELECT source, c1, want - (upto - words) AS want FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY c1) AS upto FROM a) WHERE want > 0 AND upto > want AND upto - words <= want),
y AS (SELECT x.source, x.c1, x.c2, b.want, CAST(sum(size) AS BIGINT) AS words FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.c1 = b.c1 GROUP BY ALL),
z AS (SELECT source, c1, c2, (want - (upto - words)) / words AS part FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY c2) AS upto FROM y) WHERE upto > want AND upto - words <= want)
SELECT x.doc_id, x.size, x.source_size, x.target,
  CAST(x.whole * x.size + CASE WHEN x.c1 < z.c1 OR (x.c1 = z.c1 AND x.c2 < z.c2) THEN x.size WHEN x.c1 = z.c1 AND x.c2 = z.c2 THEN floor(z.part * x.size) ELSE 0 END AS BIGINT) AS taken
FROM x LEFT JOIN z ON x.source IS NOT DISTINCT FROM z.source"""

_DIGITS = "regexp_replace(h, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1) AS INTEGER) ELSE CAST(substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1) AS INTEGER) * 2 - CASE WHEN substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
#: Kind: pattern, and what a match must pass.
_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(h, '.'), lambda x: length(ltrim(x, '0')) > 3 OR try_cast(x AS INTEGER) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
}
_HITS = [f"SELECT doc_id, {k} AS k, '{kind}' AS kind, h, place FROM (SELECT doc_id, h, sum(length(p) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) - length(h) AS place FROM (SELECT doc_id, unnest(hits) AS h, unnest(parts[1:len(hits)]) AS p, unnest(range(len(hits))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, string_split_regex(t, '{pattern}') AS parts FROM d))) WHERE {valid}" for k, (kind, (pattern, valid)) in enumerate(_BASE.items())]

PII_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS ({" UNION ALL ".join(_HITS)})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in _BASE)},
  sha256(coalesce(string_agg(concat_ws(':', kind, place, place + length(h)), ',' ORDER BY k, place), '')) AS base_sha256
FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id"""

EDITS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d)
SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 4) || left(after, n // 4)) AS edited_sha256 FROM e"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


def _shrunk(name: str, source: str, mean: str) -> str:
    """CTEs of a level with its prior's strength and its rates."""
    m = f"greatest(1e-6, least(999999e-6, {mean}))"
    return f"""{name}_q AS (SELECT sum(n * (bad / CAST(n AS DOUBLE) - {mean}) * (bad / CAST(n AS DOUBLE) - {mean}) / ({m} * (1e0 - {m}))) AS q, count(*) AS g, sum(n - 1) AS free FROM ({source}) WHERE n > 0),
{name}_k AS (SELECT 1e0 / CASE WHEN coalesce(free, 0) = 0 THEN 5e-1 ELSE least(999e-3, greatest(1e-3, (q - g) / free)) END - 1e0 AS k FROM {name}_q),
{name} AS (SELECT *, (bad + k * {mean}) / (n + k) AS rate FROM ({source}) CROSS JOIN {name}_k)"""


def hosts(rules: list[tuple[str, str, str]]) -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    last = lambda n: f"array_to_string(string_split(name, '.')[-{n}:], '.')"
    two = f"string_split(name, '.')[-2] IN ({', '.join(map(repr, SECOND))}) AND regexp_matches(string_split(name, '.')[-1], '^[a-z][a-z]$')"
    alone = "NOT contains(name, '.') OR regexp_matches(name, '^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\\[.*\\])$')"
    log = "((a - 1e0) * ln({0}) + (b - 1e0) * ln(1e0 - {0}))"
    x = f"((i + 5e-1) / {STEPS}e0)"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
i AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {case(1)} AS rule, {case(2)} AS by_rule, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '') AS name FROM i),
c AS (SELECT name, count(*) AS n, sum(CASE WHEN by_rule = 'block' OR list_has_any(regexp_split_to_array(name, '[^a-z0-9]+'), {list(SPAM)}) THEN 1 ELSE 0 END) AS bad FROM r GROUP BY 1),
j AS (SELECT *, CASE WHEN {alone} THEN name WHEN {two} THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {alone} THEN name WHEN {two} THEN {last(2)} ELSE {last(1)} END AS suffix FROM c),
top AS (SELECT (sum(bad) + 5e-1) / (sum(n) + 1) AS mean FROM j),
{_shrunk("s", "SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS mean FROM j CROSS JOIN top GROUP BY suffix", "mean")},
{_shrunk("d", "SELECT domain, j.suffix, sum(j.n) AS n, sum(j.bad) AS bad, any_value(s.rate) AS above FROM j JOIN s USING (suffix) GROUP BY domain, j.suffix", "above")},
{_shrunk("t", "SELECT name, j.n, j.bad, d.rate AS parent FROM j JOIN d ON j.domain = d.domain AND j.suffix = d.suffix", "parent")},
p AS (SELECT name, bad + k * greatest(1e-6, least(999999e-6, parent)) AS a, n - bad + k * (1e0 - greatest(1e-6, least(999999e-6, parent))) AS b FROM t),
m AS (SELECT *, {log.format("greatest(1e-6, least(999999e-6, CASE WHEN a > 1e0 AND b > 1e0 THEN (a - 1e0) / (a + b - 2e0) ELSE a / (a + b) END))")} AS peak FROM p),
f AS (SELECT name, {x} AS x, exp(least(7e2, {log.format(x)} - peak)) AS y FROM m CROSS JOIN (SELECT unnest(range({STEPS})) AS i)),
v AS (SELECT name, CASE WHEN sum(CASE WHEN x > {MAX_BAD} THEN y ELSE 0 END) / sum(y) >= {SURE} THEN 'block' ELSE 'allow' END AS by_host FROM f GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(by_rule, by_host) AS verdict FROM r JOIN v USING (name)"""
