"""Mixing sources to target weights by capped water-filling.

Native: columns of Spark SQL alone. The budget is shared by weight; sources whose share is above their cap
(most_epochs times their size) are clamped to it and the excess goes to the others by weight, until none is
above. A source's target is then met by whole repetitions of all its documents and, for the rest, one more
repetition of those whose seeded hash is smallest; where the rest ends within a cell of hashes, the documents
of that cell repeat the same fraction of their words. The last cell is found from two histograms of hashes
(CELLS by CELLS cells), summed before any shuffle, so a source that holds most rows is no burden.

Edge cases: null text has size 0 and is never taken; a null source is a source, after all others; an empty
table gives no rows; repeated rows hash alike and are taken alike; extra columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweave.llm.common import WORD, stored

CELLS, BITS = 1024, 10


def _place(id_col: str, seed: int) -> Column:
    """Seeded hash of an id, 40 bits of MD5, as SQL databases can do too."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long")


def water_fill(sources: DataFrame, budget: float) -> DataFrame:
    """sources (weight, cap, ...) with target: its weight's share of the budget, at most its cap, the excess
    shared again by weight. Each round is one aggregate; the set of clamped sources only grows."""
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(F.sum(above.cast("int")).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if (row.n or 0) == clamped or not row.weight:
            break
        clamped, level = row.n, (budget - (row.held or 0)) / row.weight
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))))


def _last_cells(sums: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """sums: keys, cell, words, want. The cell in which the running words pass want, and what remains to take there."""
    w = W.partitionBy(*keys).orderBy(cell)
    run = sums.withColumn("upto", F.sum("words").over(w))
    return run.where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("words") <= F.col("want"))).withColumn("remains", F.col("want") - (F.col("upto") - F.col("words")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_epochs: int = 2, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target, whole (repetitions), extra (words of one more), taken,
    and the columns named in keep. The table of sources (a row each) is all that is ranked in one place."""
    own = F.col(source_col)
    sized = docs.select(F.col(id_col), own.alias("src"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), *keep)
    if keep:
        slim = stored(sized.drop(*(k for k in keep if k != id_col)), "sizes")
    else:
        sized = slim = stored(sized, "sizes")
    place = _place(id_col, seed)
    first, second = F.shiftright(place, 30), F.shiftright(place, 20).bitwiseAND(CELLS - 1)
    by = slim.groupBy("src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())) - 1
    by = stored(by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most_epochs), "sources")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(by, share * total)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = stored(plan.withColumn("whole", F.floor(epochs)).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")), "plan")

    cells = slim.groupBy("src", first.alias("c1")).agg(F.sum("size").alias("words")).alias("a")
    cells = cells.join(plan.where("want > 0").select("src", "want").alias("b"), F.expr("a.src <=> b.src")).select("a.*", "want")
    one = stored(_last_cells(cells, ["src"], "c1").select("src", "c1", "remains"), "cells")
    fine = slim.withColumn("c1", first).withColumn("c2", second).alias("a").join(one.alias("b"), F.expr("a.src <=> b.src AND a.c1 = b.c1"))
    fine = fine.groupBy(F.col("a.src").alias("src"), F.col("a.c1").alias("c1"), "c2").agg(F.sum("size").alias("words"), F.first("remains").alias("want"))
    two = _last_cells(fine, ["src"], "c2").select("src", "c1", "c2", (F.col("remains") / F.col("words")).alias("part"))
    plan = stored(plan.alias("a").join(two.alias("b"), F.expr("a.src <=> b.src"), "left").select("a.*", "c1", "c2", "part"), "cuts")

    full = (first < F.col("c1")) | ((first == F.col("c1")) & (second < F.col("c2")))
    edge = (first == F.col("c1")) & (second == F.col("c2"))
    extra = F.when(full, F.col("size")).when(edge, F.floor(F.col("part") * F.col("size"))).otherwise(F.lit(0)).cast("long")
    met = sized.alias("a").join(plan.alias("b"), F.expr("a.src <=> b.src")).drop(F.col("b.src"))
    return met.select(id_col, *(k for k in keep if k != id_col), "size", "source_size", "target", F.col("whole").cast("long").alias("whole"), extra.alias("extra")).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def repeated(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mixed corpus: a row per repetition, a fractional one with the document's first words, joined by spaces."""
    copies = F.col("whole") + (F.col("extra") > 0).cast("long")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int")), " ")
    part = (F.col("copy") > F.col("whole")) & (F.col("extra") < F.col("size"))
    return mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).withColumn(text_col, F.when(part, cut).otherwise(F.col(text_col))).drop("copy")
