"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score.

Native: columns of Spark SQL alone. Base kinds (email, ip, card, phone) stay whatever their score; the
method adds an iban that passes mod 97, a card of 13 to 15 digits that passes Luhn, and a phone number
without country code, where their score reaches THRESHOLD: words near a hit, before or after it, raise the score
or lower it. Added spans that overlap a base span are dropped. Offsets count code points, from 0, end exclusive.

The expressions match what plain ones would (the comments have those), yet in time linear in the text and
without deep recursion: quantifiers that never need to give back are possessive, and a search starts only
where no earlier start in the same run could have succeeded. The places of n hits of one text take n to the power 4/3.

Edge cases: a null text is empty; an empty text has no spans; rows are independent, so repeated rows and
extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_short", "phone_local")
THRESHOLD, REACH = 0.6, 40
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: kind: (pattern, a cheap test that any hit passes)
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]"),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){15}"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "card_short": (r"(?<![0-9])[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}"),
    "phone_local": (r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
}
#: Score of a confirmed hit, and the words near it that raise it.
SCORES = {
    "email": (0.9, r"e-?mail|mail|contact|correo"),
    "ip": (0.6, r"ip|address|host|server|login"),
    "card": (0.9, r"card|visa|credit|mastercard|karte|carte|tarjeta"),
    "phone": (0.8, r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono"),
    "iban": (0.9, r"iban|account|bank|konto|compte|cuenta"),
    "card_short": (0.4, r"card|visa|credit|amex|diners|karte|carte|tarjeta"),
    "phone_local": (0.4, r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono"),
}
#: Words near a hit that lower its score, of any kind.
AGAINST = r"isbn|issn|sku|serial|version|build|invoice|order|part|article|ticket|example"
SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str, hit: str) -> str:
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    remains = f"aggregate(split(concat(substr(replace({hit}, ' ', ''), 5), substr({hit}, 1, 4)), ''), 0, (m, c) -> CASE WHEN c = '' THEN m WHEN c < 'A' THEN (m * 10 + ascii(c) - 48) % 97 ELSE (m * 100 + ascii(c) - 55) % 97 END)"
    return {
        "email": "true",
        "ip": f"{hit} RLIKE {_quoted(rf'^{BYTE}(?:[.]{BYTE}){{3}}$')}",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND luhn_check({digits})",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"length(replace({hit}, ' ', '')) BETWEEN 15 AND 34 AND {remains} = 1",
        "card_short": f"length({digits}) BETWEEN 13 AND 15 AND luhn_check({digits})",
        "phone_local": "true",
    }[kind]


def _let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value, worked out once: a lambda's variable is never inlined."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, join: str, depth: int = 2) -> str:
    """SQL of the running totals of an array of integers from 0 on, one more than it has: 0, then join of s (so far)
    and x (the next). An array that grows is copied each time, so totals are made in blocks, and the blocks' totals
    likewise: n values take n to the power 1 + 1 / (depth + 1)."""
    fold = lambda of: f"aggregate({of}, array(0), (s, y) -> concat(s, array({_let('s', 'element_at(s, -1)', _let('x', 'y', join))})))"
    if not depth:
        return fold(values)
    v, k, f, o = (f"{n}{depth}" for n in "vkfo")
    blocks = f"transform(sequence(0, (size({v}) - 1) DIV {k}), b -> {fold(f'slice({v}, b * {k} + 1, {k})')})"
    moved = f"flatten(transform({f}, (w, b) -> transform(slice(w, 1, size(w) - CASE WHEN b + 1 < size({f}) THEN 1 ELSE 0 END), x -> {_let('s', f'{o}[b]', join)})))"
    rest = _let(o, _running(f"transform({f}, w -> element_at(w, -1))", join, depth - 1), moved)
    return _let(v, values, _let(k, f"CAST(ceil(power(size({v}), 1D / {depth + 1})) AS INT)", _let(f, blocks, rest)))


def spans_of(text: str, kind: str) -> Column:
    """Spans of one kind in the column named text (never null), as an array of SPAN. What lies between hits
    gives their places: text = part, hit, part, hit, ..., part. A hit's context ends REACH code points away and at
    the second hit of its kind."""
    pattern, hint = PATTERNS[kind]
    r, (score, context) = _quoted(pattern), SCORES[kind]
    near = lambda words: "c RLIKE " + _quoted(rf"(?i)(?<!\p{{L}})(?:{words})(?!\p{{L}})")
    before = f"substring(concat(CASE WHEN i > 0 THEN concat(a[i - 1].p, a[i - 1].h) ELSE '' END, a[i].p), -{REACH})"
    around = f"concat({before}, ' ', substring(a[i + 1].p, 1, {REACH}))"
    adjusted = _let("c", around, f"greatest(0D, least(1D, {score}D + CASE WHEN {near(context)} THEN 3e-1 ELSE 0D END - CASE WHEN {near(AGAINST)} THEN 3e-1 ELSE 0D END))")
    span = f"named_struct('kind', '{kind}', 'start', o[i] + length(a[i].p), 'end', o[i + 1], 'score', {adjusted})"
    none = f"CAST(array() AS array<{SPAN}>)"
    hits = _let("o", _running("transform(a, x -> length(x.p) + coalesce(length(x.h), 0))", "s + x"), f"transform(w, i -> {span})")
    whole = _let("w", f"filter(sequence(0, size(a) - 2), i -> {_valid(kind, 'a[i].h')})", f"CASE WHEN size(w) > 0 THEN {hits} ELSE {none} END")
    pairs = f"zip_with(split({text}, {r}, -1), regexp_extract_all({text}, {r}, 0), (p, h) -> named_struct('p', p, 'h', h))"
    fold = _let("a", pairs, f"CASE WHEN size(a) > 1 THEN {whole} ELSE {none} END")
    test = f"contains({text}, '@')" if hint == "@" else f"{text} RLIKE {_quoted(hint)}"
    return F.expr(f"CASE WHEN {test} THEN {fold} ELSE {none} END")


def _meets(spans: str) -> str:
    """Whether the span x overlaps one of spans, which are in order and apart: a binary search for the last that starts
    before x ends."""
    mid = "(s.lo + s.hi) DIV 2"
    half = f"CASE WHEN s.lo >= s.hi THEN s WHEN {spans}[{mid}].start < x.end THEN named_struct('lo', CAST({mid} + 1 AS INT), 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', CAST({mid} AS INT)) END"
    last = f"aggregate(sequence(0, CAST(ceil(log2(size({spans}) + 1)) AS INT)), named_struct('lo', 0, 'hi', size({spans})), (s, _) -> {half}, s -> s.lo)"
    return f"(size({spans}) > 0 AND {_let('n', last, f'n > 0 AND {spans}[n - 1].end > x.start')})"


def find(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """df with a column of all spans: base ones by kind and start, then added ones that score enough."""
    held = df.withColumns({"__t": F.coalesce(F.col(text_col), F.lit(""))})
    held = held.withColumns({f"__{k}": spans_of("__t", k) for k in PATTERNS})
    free = " AND ".join(f"NOT {_meets(f'__{k}')}" for k in BASE)
    extra = F.expr(f"filter(concat({', '.join(f'__{k}' for k in ADDED)}), x -> x.score >= {THRESHOLD}D AND {free})")
    return held.withColumn(out, F.concat(*(F.col(f"__{k}") for k in BASE), extra)).drop("__t", *(f"__{k}" for k in PATTERNS))


def masked(text_col: str, spans: str) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first names all.
    Spans go by blocks of about the root of their number, each with its own stretch of the text, so that the text is
    not read from its start for each of them."""
    # a: spans in order; e: up to where those before one reach; q: those that none before reaches
    piece = "concat(substring(t, e[i] - lo + 1, a[i].start - e[i]), '<', upper(a[i].kind), '>')"
    stretch = _let("lo", "e[z[0]]", _let("t", f"substring({text_col}, lo + 1, a[element_at(z, -1)].start - lo)", f"array_join(transform(z, i -> {piece}), '')"))
    blocks = f"transform(sequence(0, (size(q) - 1) DIV k), b -> {_let('z', 'slice(q, b * k + 1, k)', stretch)})"
    whole = _let("k", "CAST(ceil(sqrt(size(q))) AS INT)", f"concat(array_join({blocks}, ''), substring({text_col}, element_at(e, -1) + 1))")
    first = _let("q", "filter(sequence(0, size(a) - 1), i -> a[i].start >= e[i])", whole)
    order = f"array_sort(transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    return F.expr(f"CASE WHEN size({spans}) = 0 THEN {text_col} ELSE {_let('a', order, _let('e', _running('transform(a, x -> x.end)', 'greatest(s, x)'), first))} END")


def report(found: DataFrame, id_col: str = "doc_id", spans: str = "pii") -> DataFrame:
    """Counts and digests of the spans: one row per row."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(F.col(spans), lambda x: x["kind"].isin(*BASE))
    return found.select(
        F.col(id_col),
        *(F.expr(f"CAST(size(filter(`{spans}`, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col(spans)).alias("spans"),
    )
