"""Language ID by a string kernel with Nyström landmarks.

The kernel is the blended spectrum of presence: the n-grams of 1 to 3 characters that two texts share, over
the root of the product of how many each has. On labelled texts (at most PER_LANGUAGE a language, those of
smallest seeded hash, one task) LANDMARKS a language are landmarks; the Nyström map of the kernel to them
feeds one-versus-rest kernel ridge regression. Texts are scored in batches by matrix products: presence by
landmarks, kernel by coefficients. The score is the softmax of the languages' outputs.

Edge cases: a null text, or one without any letter, is "und" with score 0; so is every text if there is no
labelled one; rows are scored independently, so repeated rows and extra columns do not matter.

Which texts are in none of the languages is told apart from the score, which only ranks the languages: of the
distinct n-grams of a text's words, punctuation and tokens with a digit left out, landmarks must hold the share
KNOWN, beyond what chance fills of the hash values. SLACK n-grams are forgiven, so that a rare name does not cost a
short text. Another script, a hash, base64 or letters in no order are not known; a Latin-script language much like a
learned one may be.
"""

from __future__ import annotations

import hashlib
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import only, stored, tidy
from geoweave.llm.grams import Grams

SIZES, BITS, PER_LANGUAGE, LANDMARKS, RIDGE, SHARP, BATCH, SENT, DENSE = (1, 2, 3), 17, 300, 24, 0.1, 4.0, 64, 100_000, 1 << 24
KNOWN, SLACK = 0.63, 2
_DIGIT, _NO_WORD = re.compile(r"\d"), re.compile(r"[\W_]+")


class Presence:
    """Batches of texts' n-gram sets as presence matrices over the landmarks' n-grams."""

    def __init__(self, columns: np.ndarray):
        self.grams = Grams(SIZES, BITS)
        self.to = np.full(1 << BITS, -1, np.int32)
        self.to[columns] = np.arange(len(columns), dtype=np.int32)
        self.width = len(columns)

    def held(self, found: np.ndarray) -> np.ndarray:
        col = self.to[found]
        return col[col >= 0]

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), self.width), np.float32)
        for i, found in enumerate(sets):
            x[i, self.held(found)] = 1
        return x


def _sizes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([max(1, len(s)) for s in sets], np.float64)


class Overlaps:
    """How many n-grams texts share with each landmark: by a product of matrices, or, where the landmarks' matrix would
    hold more than DENSE numbers, by counting the landmarks that have each of a text's n-grams."""

    def __init__(self, presence: Presence, marks: list[np.ndarray]):
        self.presence, self.n = presence, len(marks)
        if self.n * presence.width <= DENSE:
            self.matrix = presence(marks).T.copy()
        else:
            self.matrix = None
            col = np.concatenate([presence.held(m) for m in marks])
            order = np.argsort(col, kind="stable")
            self.who = np.repeat(np.arange(self.n, dtype=np.int32), [len(m) for m in marks])[order]
            self.start = np.searchsorted(col[order], np.arange(presence.width + 1))

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        if self.matrix is not None:
            return self.presence(sets) @ self.matrix
        out = np.zeros((len(sets), self.n))
        for i, found in enumerate(sets):
            if parts := [self.who[self.start[c] : self.start[c + 1]] for c in self.presence.held(found).tolist()]:
                out[i] = np.bincount(np.concatenate(parts), minlength=self.n)
        return out


def fit(sets: list[np.ndarray], langs: list[str]) -> bytes:
    """The model as bytes of an .npz file. sets of n-grams come in the order in which landmarks are picked."""
    names = sorted(set(langs))
    seen: dict[str, int] = {}
    picked = []
    for i, g in enumerate(langs):
        seen[g] = seen.get(g, 0) + 1
        if seen[g] <= LANDMARKS:
            picked.append(i)
    marks = [sets[i] for i in picked]
    columns = np.unique(np.concatenate(marks))
    overlaps, msize = Overlaps(Presence(columns), marks), _sizes(marks)
    inner = overlaps(marks) / np.sqrt(np.outer(msize, msize))
    value, vector = np.linalg.eigh(inner)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = []
    for lo in range(0, len(sets), BATCH):
        part = sets[lo : lo + BATCH]
        phi.append(overlaps(part) / np.sqrt(np.outer(_sizes(part), msize)) @ root)
    phi = np.concatenate(phi)
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1 / seen[g] for g in langs])[:, None]  # languages count alike
    ridge = RIDGE * weight.sum() / len(sets) * np.eye(phi.shape[1])
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge, phi.T @ (weight * y))
    out = io.BytesIO()
    np.savez(out, names=np.array(names), marks=np.concatenate(marks), ends=np.cumsum([len(m) for m in marks]), a=root @ solved[:-1], b=solved[-1])
    return out.getvalue()


class Scorer:
    def __init__(self, model: bytes):
        m = np.load(io.BytesIO(model))
        self.names, self.a, self.b = [str(x) for x in m["names"]], m["a"], m["b"]
        marks = np.split(m["marks"], m["ends"][:-1])
        self.presence = Presence(np.unique(m["marks"]))
        self.overlaps, self.msize = Overlaps(self.presence, marks), _sizes(marks)

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        sets = [self.presence.grams(t) for t in texts]
        kernel = self.overlaps(sets) / np.sqrt(np.outer(_sizes(sets), self.msize))
        out = kernel @ self.a + self.b
        e = np.exp(SHARP * (out - out.max(axis=1, keepdims=True)))
        e /= e.sum(axis=1, keepdims=True)
        best = out.argmax(axis=1)
        return [self.names[i] for i in best], e[np.arange(len(texts)), best]

    def known(self, text: str) -> bool:
        """Whether the text is in a learned language."""
        if _DIGIT.search(text):
            text = " ".join(w for w in text.split() if not _DIGIT.search(w))
        words = _NO_WORD.sub(" ", text).strip()
        if not words:
            return False
        found = self.presence.grams(words)
        chance = self.presence.width / (1 << BITS)
        held = np.count_nonzero(self.presence.to[found] >= 0)
        return bool(held + SLACK >= len(found) * (chance + KNOWN * (1 - chance)))


def _picked(known: DataFrame, per_language: int) -> DataFrame:
    """known (i, lang, o: a hash of i): (lang, i, rank) of the per_language ids of each language with the smallest o.
    Only hashes below a bound leave their task: one that per_language ids pass almost surely, from the languages'
    numbers of rows, and a wider one where ids repeat so often that too few did."""
    rows = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = F.least(F.lit(1.0), F.lit(per_language + 6 * per_language**0.5 + 16) / F.col("n"))
    limits = rows.select("lang", share.alias("share"))
    if rows.count() <= SENT:
        limits = F.broadcast(limits)
    wider = 1.0
    while True:
        part = F.least(F.lit(1.0), F.col("share") * wider)
        below = known.join(limits, "lang").where((part >= 1) | (F.col("o") < F.lit(-(2.0**63)) + part * F.lit(2.0**64)))
        found = stored(below.groupBy("lang").agg(F.collect_set(F.struct("o", "i")).alias("s")), "sample")
        short = limits.where(part < 1).join(found, "lang", "left").where(F.coalesce(F.size("s"), F.lit(0)) < per_language)
        if short.isEmpty():
            best = F.slice(F.array_sort("s"), 1, per_language)
            return found.select("lang", F.posexplode(best).alias("rank", "b")).select("lang", F.col("b.i").alias("i"), "rank")
        wider *= 8


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 11) -> bytes | None:
    """The model, learned from rows of docs that have a language; of rows that repeat an id in a language, from the
    text with the smallest hash."""
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), order.alias("o"))
    picked = _picked(known, per_language)
    if picked.count() <= SENT:  # else as many languages as that: joined by a shuffle
        picked = F.broadcast(picked)
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.col(lang_col).alias("g")).where(F.col("t").rlike(r"\p{L}"))
    met = texts.join(picked, (F.col("g") == F.col("lang")) & F.col("d").eqNullSafe(F.col("i")))
    one = met.groupBy("lang", "rank").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("b")).select("lang", "rank", "b.t")

    def grams(batches):
        make = Grams(SIZES, BITS)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([make(t).astype("<u4").tobytes() for t in part.column(2).to_pylist()], pa.binary())], names=["lang", "rank", "grams"])

    def work(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(k).to_pylist() for k in (1, 0, 2)), strict=True)
        if rows:
            rows.sort(key=lambda x: x[:2])
            yield pa.RecordBatch.from_arrays([pa.array([fit([np.frombuffer(r[2], "<u4") for r in rows], [r[1] for r in rows])], pa.binary())], names=["model"])

    # sets of n-grams have 2**BITS members at most, however long the texts
    got = one.mapInArrow(grams, "lang string, rank int, grams binary").repartition(1).mapInArrow(work, "model binary").collect()
    return bytes(got[0].model) if got else None


def predict(docs: DataFrame, model: bytes | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), known: bool = False) -> DataFrame:
    """The columns in keep with lang_pred and score; known: a column of that name too, whether the text is in a learned language. The model is bounded by its landmarks and broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, *([] if text_col in keep else [text_col])]
    kept = [docs.schema[k] for k in keep]
    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("known", T.BooleanType())] if known else [])])

    def work(batches):
        scorer = only(("langid", hashlib.sha256(sent.value).digest()), lambda: Scorer(sent.value)) if sent.value else None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                asked = [i for i, t in enumerate(texts) if scorer and t and any(map(str.isalpha, t))]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if asked:
                    for i, g, s in zip(asked, *scorer([texts[i] for i in asked]), strict=True):
                        langs[i], scores[i] = g, float(s)
                more = []
                if known:
                    sure = set(asked)
                    more = [pa.array([i in sure and scorer.known(t) for i, t in enumerate(texts)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more], names=[*keep, "lang_pred", "score", *(["known"] if known else [])])
        tidy()

    return docs.select(*names).mapInArrow(work, schema)
