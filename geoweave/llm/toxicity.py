"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams. On labelled texts (at most PER_CLASS a class, those of smallest
seeded hash, one task) each n-gram's ratio is the log of its smoothed share among toxic texts over that among
the others; logistic regression with a ridge is fitted on the ratios of the n-grams present, both classes
weighing alike. The FEATURES n-grams that tell the classes apart best (likelihood-ratio statistic) are used.

Edge cases: null and empty texts get the score of the intercept; without labels of both classes the score is
the share of toxic labels (0 without any); repeated labels of an id count as toxic if one is; of rows that repeat a
labelled id the text with the smallest hash is learned from; rows are scored independently, so repeated rows and
extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.grams import Grams

SIZES, BITS, PER_CLASS, FEATURES, RIDGE, ROUNDS = (3, 4, 5), 20, 4000, 5000, 10.0, 200


def fit(sets: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights of all hash values (log-count ratio times coefficient) and the intercept."""
    n, dim = len(sets), 1 << bits
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    p = np.bincount(flat[labels[row] == 1], minlength=dim) if n else np.zeros(dim)
    q = np.bincount(flat[labels[row] == 0], minlength=dim) if n else np.zeros(dim)
    if not (labels == 1).any() or not (labels == 0).any():
        return np.zeros(dim, np.float32), 0.0
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    ratio = np.log(((p + 1) / (pos + 2)) / ((q + 1) / (neg + 2)))
    ratio[p + q < 3] = 0
    expected = (p + q) * pos / (pos + neg)
    part = lambda seen, due: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9)), 0.0)
    rank = np.where(ratio == 0, 0.0, part(p, expected) + part(q, p + q - expected))
    chosen = np.argsort(-rank, kind="stable")[:FEATURES]
    chosen = chosen[rank[chosen] > 0]
    to = np.full(dim, -1, np.int64)
    to[chosen] = np.arange(len(chosen))
    col = to[flat]
    row, col = row[col >= 0], col[col >= 0]
    x = ratio[chosen][col]
    w, b = np.zeros(len(chosen)), 0.0
    gw, gb = np.full(len(chosen), 1e-8), 1e-8
    scale = np.where(labels == 1, 0.5 / pos, 0.5 / neg)
    best = (np.inf, w, b)
    for _ in range(ROUNDS):  # Adagrad on the whole sample
        z = b + np.bincount(row, x * w[col], n)
        y = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = -(scale * np.log(np.where(labels == 1, y, 1 - y) + 1e-12)).sum() + RIDGE / 2 * (w @ w) / n
        if loss < best[0]:
            best = (loss, w.copy(), b)
        e = scale * (y - labels)
        d = np.bincount(col, x * e[row], len(chosen)) + RIDGE * w / n
        gw += d * d
        gb += e.sum() ** 2
        w = w - 0.1 * d / np.sqrt(gw)
        b = b - 0.1 * e.sum() / np.sqrt(gb)
    out = np.zeros(dim, np.float32)
    out[chosen] = ratio[chosen] * best[1]
    return out, float(best[2])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, seed: int = 5) -> tuple[bytes, float] | None:
    """The model: weights as float32 bytes, and the intercept. docs and labels are those to learn from."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    picked = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(picked), id_col)  # at most 2 * per_class ids
    sample = sample.groupBy(id_col, "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("b")).select("y", "b.t")

    def hashed(batches):
        grams = Grams(SIZES, BITS)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([grams(t).astype("<u4").tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["y", "grams"])

    def work(batches):
        sets, ys = [], []
        for batch in batches:
            ys += batch.column(0).to_pylist()
            sets += [np.frombuffer(g, "<u4") for g in batch.column(1).to_pylist()]
        order = sorted(range(len(ys)), key=lambda k: (ys[k], sets[k].tobytes()))  # sums of doubles come out alike in each run
        sets = [sets[k] for k in order]
        y = np.array([ys[k] for k in order], np.int64)
        weights, b = fit(sets, y)
        if len(held := set(ys)) < 2:  # the share of toxic labels
            b = 14.0 if held == {1} else -14.0
        where = np.flatnonzero(weights).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([where.tobytes()], pa.binary()), pa.array([weights[where].astype("<f4").tobytes()], pa.binary()), pa.array([b])], names=["at", "w", "b"])

    # sets of n-grams have 2**BITS members at most, however long the texts
    row = sample.mapInArrow(hashed, "y int, grams binary").repartition(1).mapInArrow(work, "at binary, w binary, b double").collect()
    return (bytes(row[0].at), bytes(row[0].w), row[0].b) if row else None


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (score >= 0.5)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def work(batches):
        grams, w, b = Grams(SIZES, BITS), np.zeros(1 << BITS, np.float32), -14.0
        if sent.value:
            w[np.frombuffer(sent.value[0], "<u4")] = np.frombuffer(sent.value[1], "<f4")
            b = sent.value[2]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z = np.array([b + float(w[grams(t)].sum()) if t else b for t in part.column(1).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
