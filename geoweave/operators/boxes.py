"""Joins of boxes, points and segments by overlap: equi-joins on grid cells with an exact residual.

Each box has a level, the smallest power of two that is at least its longest side, and touches at most eight
cells of that size. Two boxes meet at the larger of their levels, so a box is entered at its own level and at
the higher ones that occur on the other side. A pair is kept only in the cell that holds the lower corner of
the overlap, so it comes once. No box, however large, makes many entries. A side of few entries, as counted, is
broadcast; other joins are by sorting, because Spark judges a side by the size of its files, before it is exploded.
Boxes beyond all of the other side are left out first. Rows that differ in an id alone can be met as one (alike).

Boxes have columns minx, maxx, ... of the axes joined; a point is a box with both equal. Boxes with a null or
non-finite side, or with a minimum above the maximum, match nothing. The smallest level follows from the largest
coordinate, so that cell numbers stay below 2**BITS.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions.exprs import AXES

BITS, FAR = 50, "1e300"
#: Entries of a side that is broadcast, and ids in a list of alike rows, at most.
FEW, LISTED = 50_000, 4096


def point_boxes(points: DataFrame, axes=AXES, columns=None) -> DataFrame:
    """points with min and max of each axis."""
    names = columns or axes
    return points.selectExpr("*", *(f"{c} AS {m}{a}" for a, c in zip(axes, names, strict=True) for m in ("min", "max")))


def levelled(df: DataFrame, axes) -> DataFrame:
    """Boxes that can match, with _own, their level."""
    whole = " AND ".join(f"min{a} <= max{a} AND min{a} > -{FAR} AND max{a} < {FAR}" for a in axes)
    side = "greatest(" + ", ".join(f"max{a} - min{a}" for a in axes) + ", 0e0)"
    up = f"CAST(ceil(log2(greatest({side}, 1e-300))) AS INT)"
    # the logarithm may round below a side that it should reach
    return df.where(whole).withColumn("_own", F.expr(f"CASE WHEN power(2e0, {up}) < {side} THEN {up} + 1 ELSE {up} END"))


def measured(df: DataFrame, axes) -> tuple[set[int], float, int, dict[str, tuple[float, float]]]:
    """Levels that occur (as many as a double's exponents at most), the largest coordinate, how many boxes there are, and
    from where to where they reach along each axis."""
    ends = [f(F.col(f"{m}{a}").cast("double")) for a in axes for m, f in (("min", F.min), ("max", F.max))]
    row = df.agg(F.collect_set("_own"), F.count("*"), *ends).first()
    reach = {a: (row[2 + 2 * k], row[3 + 2 * k]) for k, a in enumerate(axes)}
    return set(row[0]), max((abs(v) for e in reach.values() for v in e if v is not None), default=0.0), row[1], reach


def least_level(far: float) -> int:
    return math.frexp(far)[1] - BITS if far else -BITS


def entered(df: DataFrame, axes, others: list[int], tag: str) -> DataFrame:
    higher = f"filter(array({', '.join(map(str, others))}), l -> l > _own)" if others else "CAST(array() AS array<int>)"
    out = df.withColumn("_level", F.expr(f"explode(concat(array(_own), {higher}))"))
    out = out.withColumn("_size", F.expr("power(2e0, _level)"))
    for a in axes:
        out = out.withColumn(f"_c{a}", F.expr(f"explode(sequence(CAST(floor(min{a} / _size) AS BIGINT), CAST(floor(max{a} / _size) AS BIGINT)))"))
    keep = {"_level", "_size", *(f"_c{a}" for a in axes)}
    return out.select(*(F.col(c).alias(c if c in keep else f"{tag}{c}") for c in out.columns))


def _within(df: DataFrame, reach: dict[str, tuple[float, float]]) -> DataFrame:
    """Boxes that are not beyond all of the other side."""
    if any(v is None for e in reach.values() for v in e):
        return df.where("false")
    return df.where(" AND ".join(f"min{a} <= {hi!r}D AND max{a} >= {lo!r}D" for a, (lo, hi) in reach.items()))


def _copies(df: DataFrame, id_col: str) -> tuple[bool, int, list[str]]:
    """Whether at least half the rows repeat others but for their id, how many repeat one at most, and all but the id."""
    keys = [c for c in df.columns if c != id_col]
    kinds, rows, most = df.groupBy(*keys).count().agg(F.count("*"), F.sum("count"), F.max("count")).first()
    return 2 * kinds <= (rows or 0), most or 0, keys


def numbered(df: DataFrame, keys: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """(_kind, id) of each row, and the kinds of row by these keys: (_kind, keys), each once."""
    from geoweave.plans.session import cut

    kinds = cut(df.select(*keys).distinct().withColumn("_kind", F.monotonically_increasing_id()))
    named = df.select(F.col(id_col), *(F.col(c).alias(f"_{c}") for c in keys))
    same = F.expr(" AND ".join(f"{c} <=> _{c}" for c in keys))
    return named.join(kinds.hint("merge"), same).select("_kind", id_col), kinds


def overlap_join(left: DataFrame, right: DataFrame, axes=AXES, residual: str | None = None, by: tuple[str, ...] = (), alike: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rows whose boxes overlap (closed): columns of left as l_*, of right as r_*. residual: a further
    condition on these; by: columns of both that must be equal, too; alike: an id of each side that neither of the others
    uses. Rows of a side that differ in it alone then meet the other side once and are written out last, if they are
    many: the left ones by a join, the right ones from lists."""
    left, right = levelled(left, axes), levelled(right, axes)
    (of_left, far_left, n_left, reach_left), (of_right, far_right, n_right, reach_right) = measured(left, axes), measured(right, axes)
    least = least_level(max(far_left, far_right))
    left, right = (d.withColumn("_own", F.greatest("_own", F.lit(least))) for d in (left, right))
    left, right = _within(left, reach_right), _within(right, reach_left)
    levels = [sorted({max(v, least) for v in held}) for held in (of_left, of_right)]
    every, listed = None, None
    if alike:
        many, _, keys = _copies(left, alike[0])
        if many:
            every, left = numbered(left, keys, alike[0])
        many, most, keys = _copies(right, alike[1])
        if many:
            listed = f"r_{alike[1]}"
            part = F.pmod(F.xxhash64(alike[1]), F.lit(math.ceil(most / LISTED)))
            right = right.groupBy(*keys, part.alias("_part")).agg(F.collect_list(F.struct(alike[1])).alias("_ids")).drop("_part")
    a, b = entered(left, axes, levels[1], "l_"), entered(right, axes, levels[0], "r_")
    same = [f"_by{n}" for n in range(len(by))]
    a, b = (d.withColumns({k: F.col(f"{tag}{c}") for k, c in zip(same, by, strict=True)}) if by else d for d, tag in ((a, "l_"), (b, "r_")))
    keys = [*same, "_level", *(f"_c{x}" for x in axes)]
    test = " AND ".join(f"l_min{x} <= r_max{x} AND r_min{x} <= l_max{x} AND CAST(floor(greatest(l_min{x}, r_min{x}) / _size) AS BIGINT) = _c{x}" for x in axes)
    b, most_left, most_right = b.drop("_size"), *(n * (len(other) + 1) * 2 ** len(axes) for n, other in ((n_left, levels[1]), (n_right, levels[0])))
    if min(most_left, most_right) > FEW:
        a = a.hint("merge")
    elif most_left < most_right:
        a = F.broadcast(a)
    else:
        b = F.broadcast(b)
    met = a.join(b, keys).where("_level = greatest(l__own, r__own)").where(test)
    if residual:
        met = met.where(residual)
    met = met.drop(*keys, "_size", "l__own", "r__own")
    if every is not None:
        met = every.withColumnRenamed(alike[0], f"l_{alike[0]}").join(met.withColumnRenamed("l__kind", "_kind").hint("merge"), "_kind").drop("_kind")
    if listed:
        met = met.select(*(c for c in met.columns if c != "r__ids"), F.inline("r__ids").alias(listed))
    return met


def self_overlap(boxes: DataFrame, id_col: str, axes=AXES) -> DataFrame:
    """Each unordered pair of overlapping boxes once, each box with itself included: id_a <= id_b."""
    slim = boxes.select(id_col, *(f"{m}{a}" for a in axes for m in ("min", "max")))
    met = overlap_join(slim, slim, axes, f"l_{id_col} <= r_{id_col}")
    return met.select(F.col(f"l_{id_col}").alias(f"{id_col}_a"), F.col(f"r_{id_col}").alias(f"{id_col}_b"))
