"""Exact top-k by integer inner product.

Queries are grouped (at most QUERIES rows a group, by hash) and every group meets all candidates, which are dealt
out in shards: a shard's candidates are read in tiles, each tile one matrix product, of which the best k a query
are selected and merged into the shard's list. Lists of shards then merge in a tree, FAN at a time. Groups and
tiles hold at most ROOM components, so that memory is bounded for long vectors, too.

A component x becomes floor(scale * x), sent as 16, 32 or 64 bits, whatever the largest needs. Edge cases: vectors
that are null or hold a null or non-finite component, and rows without id, take no part; vectors meet those of
their own length only; of rows that repeat a query's id the smallest vector asks, and none of them is a candidate
for it; other repeated rows are candidates as often as they occur; ties go to the smaller id; extra columns are
ignored. Scores are exact, in doubles below 2**53 and else in integers; components or scores that do not fit 64
bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES, TILE, FAN, ROOM = 2048, 2048, 16, 1 << 22


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of scores the k best columns, ties to the smaller id, as (row, score, id); ids ascend along columns."""
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= edge[:, None])
    else:
        row, col = np.indices(scores.shape).reshape(2, -1)
    return row, scores[row, col], ids[col]


def _cut(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, in order."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    start = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - start < k
    return row[keep], score[keep], ids[keep]


def _scores(matrix: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of integers, as doubles if these are exact, else as integers."""
    if not tile.size or not matrix.size or float(np.abs(tile).max()) * float(np.abs(matrix).max()) * tile.shape[1] < 2.0**53:
        return matrix @ tile.T.astype(np.float64)
    if np.abs(matrix @ tile.T.astype(np.float64)).max() >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("a score does not fit 64 bits")
    return matrix.astype(np.int64) @ tile.astype(np.int64).T  # sums that wrap on the way come out right


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the queries among vectors (is_query: a condition on them)."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(whole, F.lit(False)))
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.agg(F.max(F.size(v)).alias("dim"), F.max(F.array_max(F.transform(v, lambda x: F.abs(F.lit(float(scale)) * x.cast("double"))))).alias("most"), F.countDistinct(F.when(is_query, F.col(id_col))).alias("asked")).first()
    most = (sizes.most or 0) + 1
    if most >= 2.0**63:
        raise OverflowError("a component does not fit 64 bits")
    kind = "short" if most < 2**15 else "int" if most < 2**31 else "long"
    tile = max(1, min(TILE, ROOM // max(1, sizes.dim or 1)))
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast(kind))
    asked = rows.where(is_query).select(F.col(id_col).alias("id"), scaled.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    groups = max(1, -(-sizes.asked // min(QUERIES, tile)))
    shards = max(1, parts // groups)
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")
    queries = asked.select(F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"), "v", group, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    candidates = rows.select(F.lit(1).alias("kind"), F.col(id_col).cast("long").alias("id"), scaled.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(shards)).cast("int").alias("shard"))
    # a cell is a group and a shard; each is a task of its own
    dealt = queries.unionByName(candidates).select((F.col("g") * shards + F.col("shard")).alias("cell"), "shard", F.size("v").alias("dim"), "kind", "id", "v")
    dealt = dealt.repartitionById(groups * shards, F.col("cell")).sortWithinPartitions("cell", "dim", "kind")

    def work(batches):
        key, shard, who, matrix, best = None, 0, [], [], None

        def done():
            if best and len(best[0]):
                ids = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), pa.array(best[1]), pa.array(np.full(len(best[0]), shard, np.int32))], names=["query_id", "vec_id", "score", "shard"])

        for batch in batches:
            cells, shards_, dims, kinds, ids = (batch.column(n).to_numpy() for n in range(5))
            turn = np.flatnonzero((np.diff(cells) != 0) | (np.diff(dims) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if (cells[a], dims[a]) != key:
                    yield from done()
                    key, shard, who, matrix, best = (cells[a], dims[a]), shards_[a], [], [], None
                for lo in range(a, b, tile):
                    part = batch.column(5).slice(lo, min(tile, b - lo))
                    values = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims[a])
                    own = ids[lo : lo + len(part)]
                    if kinds[a] == 0:
                        who.append(own)
                        matrix.append(values.astype(np.float64 if kind != "long" else np.int64))
                        continue
                    if not who:
                        break
                    if len(who) > 1:
                        who, matrix = [np.concatenate(who)], [np.concatenate(matrix)]
                    order = np.argsort(own, kind="stable")
                    own, values = own[order], values[order]
                    s = _scores(matrix[0], values)
                    none = -np.inf if s.dtype == np.float64 else np.iinfo(np.int64).min
                    s[who[0][:, None] == own[None, :]] = none
                    row, score, found = _best(s, own, k)
                    real = score != none
                    row, score, found = row[real], score[real].astype(np.int64), found[real]
                    best = _cut(*(np.concatenate(x) for x in zip(best, (row, score, found), strict=True)), k) if best else _cut(row, score, found, k)
        yield from done()

    lists = dealt.mapInArrow(work, "query_id long, vec_id long, score long, shard int")
    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        rank = F.row_number().over(W.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "vec_id"))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k)
        shards = -(-shards // FAN)
        if shards <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
