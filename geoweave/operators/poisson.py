"""Blue-noise sampling: thinning of given points, and generation in a box or a domain.

Accepted points are strictly more than r apart. Thinning in a seeded random order is a lexicographically first
maximal independent set, and rounds of "accept what no live neighbour precedes, drop the neighbours" give the
same set as one point after the other, in few rounds. Generators draw from a hash of (seed, wave, point, try),
so a run again gives the same points. Every loop ends its lineage by a checkpoint. Contours alone are walked point
by point, as each place depends on the one before: a task has whole polygons.
"""

from __future__ import annotations

import itertools
import math
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions.exprs import AXES
from geoweave.functions.random import uniform
from geoweave.operators.boxes import overlap_join, point_boxes
from geoweave.plans.session import cut

#: Darts of the longest batch; draws in a row that may fail on a stretch of a contour.
MOST, FAILS = 1 << 17, 50


def priority(seed: int = 1, id_col: str = "point_id") -> str:
    """Integer order that SQL databases can make too: products stay below 2**63."""
    return f"((({id_col} % 2147483647) * 48271 + {seed}) % 2147483647 * 69621) % 2147483647"


def close_pairs(a: DataFrame, b: DataFrame, r: float, axes=AXES) -> DataFrame:
    """(a_id, b_id) of points at most r apart. Both have point_id and the axes."""
    around = a.selectExpr("point_id", *axes, *(f"{x} - {r!r}D AS min{x}" for x in axes), *(f"{x} + {r!r}D AS max{x}" for x in axes))
    d2 = " + ".join(f"(l_{x} - r_{x}) * (l_{x} - r_{x})" for x in axes)
    met = overlap_join(around, point_boxes(b.select("point_id", *axes), axes), axes, f"({d2}) <= {r * r!r}D")
    return met.select(F.col("l_point_id").alias("a_id"), F.col("r_point_id").alias("b_id"))


def thin(points: DataFrame, r: float, seed: int = 1, seeds: DataFrame | None = None, axes=AXES, order: str | None = None) -> DataFrame:
    """The points that a greedy pass in seeded random order (or in that of the expression order) keeps; seeds are
    accepted before and not returned."""
    live = points
    if seeds is not None:
        near = close_pairs(points, seeds.withColumn("point_id", -F.col("point_id") - 1), r, axes).select(F.col("a_id").alias("point_id")).distinct()
        live = live.join(near, "point_id", "left_anti")
    live = cut(live.withColumn("_p", F.expr(order or priority(seed))))
    ranks = live.select("point_id", "_p")
    pairs = close_pairs(live, live, r, axes).where("a_id <> b_id")
    pairs = pairs.join(ranks.select(F.col("point_id").alias("a_id"), F.col("_p").alias("pa")), "a_id").join(ranks.select(F.col("point_id").alias("b_id"), F.col("_p").alias("pb")), "b_id")
    blocked = cut(pairs.where("pb < pa OR (pb = pa AND b_id < a_id)").select("a_id", "b_id"))  # a waits for b
    left, out = ranks.select("point_id"), None
    while True:
        won = left.join(blocked.select(F.col("a_id").alias("point_id")).distinct(), "point_id", "left_anti")
        won = cut(won)
        out = won if out is None else out.unionByName(won)
        dead = cut(blocked.join(won.select(F.col("point_id").alias("b_id")), "b_id", "left_semi").select(F.col("a_id").alias("point_id")).distinct())
        left = cut(left.join(won, "point_id", "left_anti").join(dead, "point_id", "left_anti"))
        if left.isEmpty():
            return live.drop("_p").join(out, "point_id", "left_semi")
        gone = dead.select("point_id")
        blocked = cut(blocked.join(gone.withColumnRenamed("point_id", "a_id"), "a_id", "left_anti").join(gone.withColumnRenamed("point_id", "b_id"), "b_id", "left_anti"))


def _numbered(df: DataFrame, first: int) -> DataFrame:
    """point_id: numbers from first on, in the order of (origin, try), which a wave's rows are unique by."""
    from geoweave.operators.mesh import offsets

    keyed = df.withColumns({"_key": F.struct("origin", "try"), "_one": F.lit(1)})
    return offsets(keyed, "_key", "_one").withColumn("point_id", F.col("offset") + first).drop("_key", "_one", "offset")


def annulus(parents: DataFrame, k: int, r: float, seed: int, wave: int, axes=AXES, test: str = "true", trials: int = 2000) -> DataFrame:
    """k candidates a parent, each the first of trials draws that passes the test, if any does: a direction drawn
    from the cube, made a unit, and a radius in [r, 2r)."""
    slots = parents.selectExpr("point_id AS origin", *(f"{a} AS o{a}" for a in axes), f"explode(sequence(0, {k - 1})) AS try")

    def drawn(rows: DataFrame, lo: int, hi: int) -> DataFrame:
        out = rows.selectExpr("*", f"explode(sequence({lo}, {hi - 1})) AS trial")
        out = out.selectExpr("*", *(f"2e0 * {uniform('origin', 'try', 'trial', seed, wave, n)} - 1e0 AS u{a}" for n, a in enumerate(axes)), f"{r!r}D * (1e0 + {uniform('origin', 'try', 'trial', seed, wave, 9)}) AS far")
        out = out.withColumn("len", F.expr("sqrt(" + " + ".join(f"u{a} * u{a}" for a in axes) + ")"))
        out = out.where("len > 0e0").selectExpr("origin", "try", "trial", *(f"o{a} + u{a} / len * far AS {a}" for a in axes)).where(test)
        return out.groupBy("origin", "try").agg(F.min(F.struct("trial", *axes)).alias("c")).select("origin", "try", *(f"c.{a}" for a in axes))

    few = min(trials, 16)  # most candidates need few draws
    first = cut(drawn(slots, 0, few))
    left = cut(slots.join(first, ["origin", "try"], "left_anti"))
    if few == trials or left.isEmpty():
        return first
    return first.unionByName(drawn(left, few, trials))


def _inside(low, high, axes) -> str:
    return " AND ".join(f"{a} BETWEEN {lo!r}D AND {hi!r}D" for a, lo, hi in zip(axes, low, high, strict=True))


def bridson(spark: SparkSession, low, high, r: float, k: int = 30, seed: int = 1, domain: str | None = None, seeds: DataFrame | None = None, axes=AXES, trials: int = 2000) -> DataFrame:
    """(point_id, axes): waves of candidates around the points accepted last; each point has one batch of k. domain:
    a condition on the axes; the first point is the first of trials draws that satisfies it, if no seeds are given."""
    test = _inside(low, high, axes) + (f" AND ({domain})" if domain else "")
    if seeds is None:
        draws = spark.range(trials).selectExpr("id", *(f"{lo!r}D + {hi - lo!r}D * {uniform('id', seed, n)} AS {a}" for n, (a, lo, hi) in enumerate(zip(axes, low, high, strict=True))))
        seeds = draws.where(test).orderBy("id").limit(1).selectExpr("CAST(0 AS BIGINT) AS point_id", *axes)
    done = active = cut(seeds.select("point_id", *axes))
    wave, first = 1, (done.agg(F.max("point_id")).first()[0] or 0) + 1
    while not active.isEmpty():
        fresh = cut(_numbered(annulus(active, k, r, seed, wave, axes, test, trials), first).select("point_id", *axes))
        first += fresh.count()
        active = cut(thin(fresh, r, seed + wave, done, axes))
        done = cut(done.unionByName(active))
        wave += 1
    return done


def naive(spark: SparkSession, low, high, r: float, seed: int = 1, fails: int = 2000, axes=AXES) -> DataFrame:
    """Darts, one after the other, until so many in a row lie within r of those accepted; point_id is a dart's number.
    Darts come in batches, each twice as long as the one before, but MOST at the longest; of a batch the accepted ones
    are ranked in one place."""
    from pyspark.sql import Window as W

    done, at, last, size = None, 0, -1, fails
    while True:
        draws = spark.range(at, at + size).selectExpr("id AS point_id", *(f"{lo!r}D + {hi - lo!r}D * {uniform('id', seed, n)} AS {a}" for n, (a, lo, hi) in enumerate(zip(axes, low, high, strict=True))))
        fresh = cut(thin(draws, r, seed, None if done is None else done, axes, order="point_id"))
        gap = F.col("point_id") - F.lag("point_id", 1, last).over(W.orderBy("point_id"))
        row = fresh.withColumn("gap", gap).agg(F.min(F.when(F.col("gap") > fails, F.col("point_id"))).alias("late"), F.max("point_id").alias("last")).first()
        if row.late is not None:
            fresh = fresh.where(F.col("point_id") < row.late)
        done = cut(fresh if done is None else done.unionByName(fresh))
        last, at = row.last if row.last is not None else last, at + size
        if row.late is not None or at - last > fails:
            return done
        size = min(2 * size, MOST)


def _walk(corners: list[tuple[float, ...]], r: float, seed: int, name) -> list[tuple[float, ...]]:
    """Points along a closed polygon: on each side the next is drawn from r to 2 r after the last one; where FAILS draws
    in a row are too close to a point of any side, the stretch that is drawn from moves on to its own end."""
    import random

    draw, near, out = random.Random(f"{seed}:{name}"), {}, []
    reach = list(itertools.product((-1, 0, 1), repeat=len(corners[0]) if corners else 0))
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        length, at = math.dist(a, b), 0.0
        end, misses = min(length, r), 0
        while at < length:
            s = draw.uniform(at, end)
            p = tuple(s / length * x + (1 - s / length) * y for x, y in zip(a, b, strict=True))
            cell = tuple(math.floor(x / r) for x in p)
            if all(math.dist(p, q) > r for d in reach for q in near.get(tuple(map(operator.add, cell, d)), ())):
                near.setdefault(cell, []).append(p)
                out.append(p)
                at, end, misses = s + r, min(length, s + 2 * r), 0
            elif misses + 1 < FAILS:
                misses += 1
            else:
                at, end, misses = end, min(length, 2 * end), 0
    return out


def contour(polygon: DataFrame, r: float, seed: int = 1, axes=("x", "y")) -> DataFrame:
    """(polygon_id, point_id, axes): points along closed polygons (polygon_id, vertex_no and axes)."""
    kind = polygon.schema["polygon_id"].dataType.simpleString()

    def walked(rows):
        import pandas as pd

        rows = rows.sort_values("vertex_no")
        out = _walk(list(rows[list(axes)].itertuples(index=False, name=None)), r, seed, rows["polygon_id"].iloc[0])
        return pd.DataFrame({"polygon_id": rows["polygon_id"].iloc[0], "point_id": range(len(out)), **{a: [p[k] for p in out] for k, a in enumerate(axes)}})

    slim = polygon.select("polygon_id", "vertex_no", *axes)
    return slim.groupBy("polygon_id").applyInPandas(walked, f"polygon_id {kind}, point_id long, {', '.join(f'{a} double' for a in axes)}")


def too_close(points: DataFrame, r: float, axes=AXES) -> DataFrame:
    """Violations: pairs at most r apart."""
    return close_pairs(points, points, r, axes).where("a_id < b_id")


def uncovered(points: DataFrame, kept: DataFrame, r: float, axes=AXES) -> DataFrame:
    """Violations of maximality: points that nothing kept is within r of."""
    near = close_pairs(points, kept, r, axes).select(F.col("a_id").alias("point_id")).distinct()
    return points.join(near, "point_id", "left_anti")
