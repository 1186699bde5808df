"""Geometry as SQL text, one arithmetic for every caller.

Each function returns either an expression or steps: a list of (name, expression) in which later ones may use
the names of earlier ones (lateral column aliases). Floating literals are written with an exponent, because
0.5 is a decimal in SQL; every division has a guarded divisor, because the optimiser may move a projection
below the filter that would have protected it.
"""

from __future__ import annotations

AXES = ("x", "y", "z")


def steps(pairs: list[tuple[str, str]]) -> list[str]:
    return [f"{e} AS {n}" for n, e in pairs]


def apply(df, pairs: list[tuple[str, str]], drop: bool = False):
    """df with the steps as columns; with drop, only columns whose name has no leading underscore stay."""
    out = df.selectExpr("*", *steps(pairs))
    return out.drop(*[n for n, _ in pairs if n.startswith("_")]) if drop else out


def vec(prefix: str) -> tuple[str, str, str]:
    return tuple(f"{prefix}{a}" for a in AXES)


def minus(a, b):
    return tuple(f"({p} - {q})" for p, q in zip(a, b, strict=True))


def dot(a, b) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def cross(a, b):
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def named(prefix: str, value) -> list[tuple[str, str]]:
    return [(f"{prefix}{a}", v) for a, v in zip(AXES, value, strict=True)]


def sq_distance(a, b) -> str:
    d = minus(a, b)
    return dot(d, d)


def in_box(p, lo, hi) -> str:
    """Closed."""
    return "(" + " AND ".join(f"{x} >= {a} AND {x} <= {b}" for x, a, b in zip(p, lo, hi, strict=True)) + ")"


def overlap(a: str, b: str, axes=AXES) -> str:
    """Closed overlap of boxes with columns min*, max* under two prefixes."""
    return "(" + " AND ".join(f"{a}min{x} <= {b}max{x} AND {b}min{x} <= {a}max{x}" for x in axes) + ")"


def facet_box(t: str = "t") -> list[tuple[str, str]]:
    """minx ... maxz of the triangle with corners t0, t1, t2."""
    return [(f"{m}{a}", f"{f}({t}0{a}, {t}1{a}, {t}2{a})") for a in AXES for m, f in (("min", "least"), ("max", "greatest"))]


def barycentre(t: str = "t") -> list[tuple[str, str]]:
    return [(f"c{a}", f"({t}0{a} + {t}1{a} + {t}2{a}) / 3e0") for a in AXES]


def tet_volume(a, b, c, d) -> str:
    """Signed volume of a tetrahedron."""
    return f"({dot(minus(b, a), cross(minus(c, a), minus(d, a)))} / 6e0)"


def point_box_sq(p, lo, hi) -> str:
    """Squared distance from a point to a box; inside, minus the squared distance to the nearest side."""
    out = [f"greatest({a} - {x}, 0e0, {x} - {b})" for x, a, b in zip(p, lo, hi, strict=True)]
    side = "least(" + ", ".join(f"{x} - {a}, {b} - {x}" for x, a, b in zip(p, lo, hi, strict=True)) + ")"
    return f"CASE WHEN {in_box(p, lo, hi)} THEN -({side} * {side}) ELSE {dot(out, out)} END"


def point_box_centre_sq(p, lo, hi) -> str:
    mid = tuple(f"(({a} + {b}) / 2e0)" for a, b in zip(lo, hi, strict=True))
    return sq_distance(p, mid)


def triangle_sq(p: str = "p", t: str = "t", out: str = "d2") -> list[tuple[str, str]]:
    """Squared distance from point p to the triangle: to its plane, if the foot lies inside; else to the nearest
    edge. Triangles without area have their edges alone."""
    point, a, b, c = vec(p), vec(f"{t}0"), vec(f"{t}1"), vec(f"{t}2")
    pairs = named("_n", cross(minus(b, a), minus(c, a))) + [("_nn", dot(vec("_n"), vec("_n")))]
    edges = []
    for k, (u, v) in enumerate(((a, b), (b, c), (c, a))):
        pairs += named(f"_e{k}", minus(v, u)) + named(f"_w{k}", minus(point, u))
        e, w = vec(f"_e{k}"), vec(f"_w{k}")
        pairs += [(f"_s{k}", f"coalesce(least(greatest({dot(w, e)} / nullif({dot(e, e)}, 0e0), 0e0), 1e0), 0e0)")]
        rest = tuple(f"({x} - _s{k} * {y})" for x, y in zip(w, e, strict=True))
        pairs += [(f"_d{k}", dot(rest, rest)), (f"_i{k}", dot(cross(e, w), vec("_n")))]
        edges.append(f"_d{k}")
    foot = dot(vec("_w0"), vec("_n"))
    pairs += [(out, f"CASE WHEN _nn > 0e0 AND _i0 >= 0e0 AND _i1 >= 0e0 AND _i2 >= 0e0 THEN {foot} * {foot} / nullif(_nn, 0e0) ELSE least({', '.join(edges)}) END")]
    return pairs


def column_hit(x: str, y: str, t: str = "t") -> list[tuple[str, str]]:
    """A vertical line at (x, y) against the triangle: hit, z and sign (of the triangle's area seen from above:
    +1, -1; 0 for vertical ones). Ties are broken so that a shared edge belongs to one triangle: of an edge
    (u, v) the area decides, then the order in y, then that in x."""
    pairs = [(f"_{a}{k}", f"({t}{k}{a} - {v})") for k in range(3) for a, v in (("x", x), ("y", y))]
    for name, (u, v) in (("a", (1, 2)), ("b", (2, 0)), ("c", (0, 1))):
        pairs += [(f"_{name}", f"(_y{u} * _x{v} - _x{u} * _y{v})")]
        # the first of three signs that is not 0; each is written once, as filters repeat what they stand on
        pairs += [(f"_{name}s", f"sign(4e0 * sign(_{name}) + 2e0 * sign(_y{v} - _y{u}) + sign(_x{u} - _x{v}))")]
    pairs += [
        ("z", f"(_a * {t}0z + _b * {t}1z + _c * {t}2z) / nullif(_a + _b + _c, 0e0)"),
        ("_det", f"(({t}1x - {t}0x) * ({t}2y - {t}0y) - ({t}1y - {t}0y) * ({t}2x - {t}0x))"),
        ("sign", "CAST(sign(_det) AS INT)"),
        ("hit", "(_a + _b + _c <> 0e0 AND _as = _bs AND _bs = _cs AND _cs <> 0e0)"),
    ]
    return pairs


def tet_planes(t: str = "t") -> list[tuple[str, str]]:
    """Of a tetrahedron t0..t3 the normals n0..n3 of its sides, worked out once: that of a corner's side tells the
    volume that the corner would make elsewhere."""
    c = [vec(f"{t}{k}") for k in range(4)]
    side = lambda a, u, v: cross(minus(c[u], c[a]), minus(c[v], c[a]))
    return [*named("n0", side(1, 3, 2)), *named("n1", side(0, 2, 3)), *named("n2", side(0, 3, 1)), *named("n3", side(0, 1, 2))]


def in_planes(p: str = "p", t: str = "t") -> str:
    """Closed containment of a point in a tetrahedron with its planes: four volumes of one sign."""
    v = [dot(minus(vec(p), vec(f"{t}{0 if k else 1}")), vec(f"n{k}")) for k in range(4)]
    return "((" + " AND ".join(f"{x} >= 0e0" for x in v) + ") OR (" + " AND ".join(f"{x} <= 0e0" for x in v) + "))"


def in_tet(p: str = "p", t: str = "t") -> str:
    """Closed containment of a point in a tetrahedron t0..t3: four volumes of one sign."""
    point, c = vec(p), [vec(f"{t}{k}") for k in range(4)]
    v = [tet_volume(*(point if j == k else c[j] for j in range(4))) for k in range(4)]
    return "((" + " AND ".join(f"{x} >= 0e0" for x in v) + ") OR (" + " AND ".join(f"{x} <= 0e0" for x in v) + "))"


def slab(q1, q2, lo, hi) -> list[tuple[str, str]]:
    """Segment q1 q2 against a box, closed, boxes without thickness included: column slab."""
    pairs, near, far, still = [], [], [], []
    for a, p, q, l, h in zip(AXES, q1, q2, lo, hi, strict=True):
        pairs += [(f"_l{a}", f"({l} - {p}) / nullif({q} - {p}, 0e0)"), (f"_h{a}", f"({h} - {p}) / nullif({q} - {p}, 0e0)")]
        near.append(f"coalesce(least(_l{a}, _h{a}), -1e300)")
        far.append(f"coalesce(greatest(_l{a}, _h{a}), 1e300)")
        still.append(f"({p} <> {q} OR ({p} >= {l} AND {p} <= {h}))")
    return [*pairs, ("_tmin", f"greatest({', '.join(near)})"), ("_tmax", f"least({', '.join(far)})"), ("slab", f"({' AND '.join(still)} AND _tmax >= 0e0 AND _tmin <= _tmax AND _tmin <= 1e0)")]


def facet_plane(t: str = "t") -> list[tuple[str, str]]:
    """A triangle's normal nx, ny, nz and the plane's offset nc: worked out once a facet, not once a pair."""
    p0, p1, p2 = vec(f"{t}0"), vec(f"{t}1"), vec(f"{t}2")
    return [*named("n", cross(minus(p1, p0), minus(p2, p0))), ("nc", dot(vec("n"), p0))]


def sides(q1: str = "p", q2: str = "q") -> tuple[str, str]:
    """Where the ends of a segment lie of a triangle's plane (nx ... nc): below 0, on it, above."""
    return tuple(f"({dot(vec(q), vec('n'))} - nc)" for q in (q1, q2))


def straddles(q1: str = "p", q2: str = "q", t: str = "t") -> list[str]:
    """Conditions, cheap ones first, that a segment meets a triangle: its ends lie on different sides or touch, and its
    line passes on one side of all edges."""
    f, g = sides(q1, q2)
    a, b = vec(q1), vec(q2)
    turn = lambda u, v: f"sign({dot(minus(b, a), cross(minus(vec(u), a), minus(vec(v), a)))})"
    v = [turn(f"{t}{k}", f"{t}{(k + 1) % 3}") for k in range(3)]
    return [f"{f} * {g} <= 0e0", f"{v[0]} = {v[1]}", f"{v[1]} = {v[2]}"]


def segment_box(q1, q2, lo, hi) -> str:
    """Segment against a closed box by separating axes: the box's own, and those across the segment and an axis."""
    tests = [f"least({p}, {q}) <= {h} AND greatest({p}, {q}) >= {l}" for p, q, l, h in zip(q1, q2, lo, hi, strict=True)]
    d = [f"({q} - {p})" for p, q in zip(q1, q2, strict=True)]
    c = [f"({p} + {q} - {l} - {h})" for p, q, l, h in zip(q1, q2, lo, hi, strict=True)]
    size = [f"({h} - {l})" for l, h in zip(lo, hi, strict=True)]
    for u, v in ((1, 2), (2, 0), (0, 1)):
        tests.append(f"abs({d[u]} * {c[v]} - {d[v]} * {c[u]}) <= {size[u]} * abs({d[v]}) + {size[v]} * abs({d[u]})")
    return " AND ".join(tests)


def nearest_on_triangle(p: str = "p", t: str = "t") -> list[tuple[str, str]]:
    """The point x, y, z of a triangle that is nearest to point p: its foot in the plane, if inside, else on an edge."""
    pairs = triangle_sq(p, t, "_dd")
    foot = f"{dot(vec('_w0'), vec('_n'))} / nullif(_nn, 0e0)"
    inside = "_nn > 0e0 AND _i0 >= 0e0 AND _i1 >= 0e0 AND _i2 >= 0e0"
    out = []
    for a in AXES:
        on = [f"{t}{k}{a} + _s{k} * _e{k}{a}" for k in range(3)]
        out.append((a, f"CASE WHEN {inside} THEN {p}{a} - {foot} * _n{a} WHEN _d0 <= _d1 AND _d0 <= _d2 THEN {on[0]} WHEN _d1 <= _d2 THEN {on[1]} ELSE {on[2]} END"))
    return [*pairs, *out]


def linear_index(i: str, j: str, k: str, nx: int, ny: int) -> str:
    """x fastest."""
    return f"((CAST({k} AS BIGINT) * {ny} + {j}) * {nx} + {i})"


def from_linear(n: str, nx: int, ny: int) -> tuple[str, str, str]:
    """(i, j, k) of a linear index."""
    return (f"CAST({n} % {nx} AS INT)", f"CAST(CAST(floor({n} / {nx}) AS BIGINT) % {ny} AS INT)", f"CAST(floor({n} / {nx * ny}) AS INT)")


def clamped(i: str, n: int) -> str:
    return f"greatest(0, least({i}, {n - 1}))"


def valid(i: str, j: str, k: str, size: tuple[int, int, int]) -> str:
    return "(" + " AND ".join(f"{v} BETWEEN 0 AND {n - 1}" for v, n in zip((i, j, k), size, strict=True)) + ")"


def morton(i: str, j: str, k: str, bits: int = 10) -> str:
    """Interleaved bits of three cell numbers, i lowest."""
    return "(" + " + ".join(f"(CAST(floor({v} / {1 << b}) AS BIGINT) % 2) * {1 << (3 * b + a)}" for b in range(bits) for a, v in enumerate((i, j, k))) + ")"


def morton_decode(m: str, bits: int = 10) -> tuple[str, str, str]:
    return tuple("(" + " + ".join(f"(CAST(floor({m} / {1 << (3 * b + a)}) AS BIGINT) % 2) * {1 << b}" for b in range(bits)) + ")" for a in range(3))


def next_pow2(x: str, strict: bool = False) -> str:
    """Smallest power of two that is at least x (strict: above x), as a BIGINT: x is below 2**62."""
    least = f"CAST(floor({x}) AS BIGINT)" if strict else f"(CAST(ceil({x}) AS BIGINT) - 1)"
    return f"CASE WHEN {least} <= 0 THEN CAST(1 AS BIGINT) ELSE shiftleft(CAST(1 AS BIGINT), length(bin({least}))) END"


def n_bits(x: str) -> str:
    """floor(log2 x) + 1; 0 for 0 and less."""
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE length(bin(CAST({x} AS BIGINT))) END"


def is_pow2(x: str) -> str:
    return f"({x} > 0 AND ({x} & ({x} - 1)) = 0)"


#: Corners of a unit cube in ring order and in lexicographic order (fixed values).
RING = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
LEXICOGRAPHIC = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1))
#: Of the six sides of a voxel (axis, direction) the corners, in ring order, of two triangles (fixed values).
SIDES = {
    (0, -1): ((0, 4, 3), (3, 4, 7)),
    (0, 1): ((2, 6, 1), (1, 6, 5)),
    (1, -1): ((1, 5, 0), (0, 5, 4)),
    (1, 1): ((3, 7, 2), (2, 7, 6)),
    (2, -1): ((1, 0, 2), (2, 0, 3)),
    (2, 1): ((4, 5, 7), (7, 5, 6)),
}
