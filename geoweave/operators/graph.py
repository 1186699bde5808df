"""Connected components of links, in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.plans.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, least) for each node of the links: the smallest node that it reaches. In each round every node takes the
    smallest name among its own, its neighbours' and that of the node it is named after, until no name changes."""
    both = cut(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(b, a)).where("node <> other").distinct())
    named = cut(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("least")))
    while True:
        near = both.join(named.select(F.col("node").alias("other"), "least"), "other").groupBy("node").agg(F.min("least").alias("near"))
        step = named.join(near, "node").select("node", F.least("least", "near").alias("next"), "least")
        after = step.select("node", F.col("next").alias("name"), "least").join(named.select(F.col("node").alias("name"), F.col("least").alias("root")), "name", "left")
        moved = cut(after.select("node", F.least("name", F.coalesce("root", "name")).alias("now"), "least"))
        changed = not moved.where("now <> least").isEmpty()
        named = moved.select("node", F.col("now").alias("least"))
        if not changed:
            return named
