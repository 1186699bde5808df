"""Document fingerprints by I-Match with randomised lexicons.

Document frequencies are counted over all documents. The lexicon is the terms within a band of inverse
document frequency, given as shares of documents; since a document has T terms on average, at most
T / (lower share) terms are within it, and the lower share is raised where that would pass MOST_TERMS, so the
lexicon can be broadcast. A text's distinct terms of the lexicon are sorted, and each of SUBSETS random
subsets of the lexicon (PER_RATE at each of RATES) gives the hash of those in it; the fingerprint is these
hashes, "." for none. Likeness looks at the rarest rate at which both texts have terms in most subsets and is
the share of subsets with terms whose hashes agree. A text with fewer than FEW terms of the lexicon uses all
its terms, so that different texts of rare terms differ.

Edge cases: a null text is empty; an empty text's fingerprint is all "." and is like another empty one's
only; equal texts have equal fingerprints; rows without id come before all others; rows that repeat an id
follow one another in the order of their texts' hashes; a single document is its own next; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import LONG, Bounded, stored

LOWER_SHARE, UPPER_SHARE, MOST_TERMS, FEW = 0.002, 0.1, 500_000, 4
RATES, PER_RATE = (4, 16, 64, 256), 8
SUBSETS = len(RATES) * PER_RATE
#: Letters A-Z in lower case, ASCII punctuation and control characters as spaces.
FOLD = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))
GOLD = 0x9E3779B97F4A7C15
FIRST_KEY = -(1 << 63)
#: Documents of a range at the most, where they are spread evenly.
RANGE = 100_000


def terms(text: str) -> set[bytes]:
    return set(text.encode().translate(FOLD).split())


def _hash(term: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term)


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(term hash, document frequency); the row with a null hash has the number of documents."""

    def work(batches):
        held: dict[bytes | int, int] = {}  # by hash, if longer than LONG
        docs_seen = 0

        def flush():
            keys = np.fromiter((w if isinstance(w, int) else _hash(w) for w in held), np.uint64, len(held)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["term", "n"])
            held.clear()

        for batch in batches:
            docs_seen += batch.num_rows
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(at, 256).to_pylist():
                    if t:
                        found = terms(t)
                        if max(map(len, found), default=0) > LONG:
                            found = {w if len(w) <= LONG else _hash(w) for w in found}
                        for w in found:
                            held[w] = held.get(w, 0) + 1
                if len(held) > 400_000:
                    yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs_seen], pa.int64())], names=["term", "n"])

    return docs.select(text_col).mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", lower: float = LOWER_SHARE, upper: float = UPPER_SHARE) -> np.ndarray:
    """Hashes of the terms within the band, ascending: at most MOST_TERMS."""
    df = stored(_counted(docs, text_col), "df")
    row = df.agg(F.sum(F.when(F.col("term").isNull(), F.col("df"))).alias("docs"), F.sum(F.when(F.col("term").isNotNull(), F.col("df"))).alias("all")).first()
    n, total = row.docs or 0, row.all or 0
    least = max(lower * n, total / MOST_TERMS, 2)
    got = df.where(F.col("term").isNotNull() & (F.col("df") >= least) & (F.col("df") <= max(upper * n, least))).select("term").toArrow()
    return np.sort(got.column(0).to_numpy().astype(np.int64).view(np.uint64)) if got.num_rows else np.zeros(0, np.uint64)


class Fingerprints:
    def __init__(self, lexicon: np.ndarray, seed: int = 23):
        self.lexicon = lexicon
        held = set(lexicon.tolist())
        # 0: not in the lexicon
        self.within = Bounded(lambda w: h if (h := _hash(w)) in held else 0, 150_000)
        draw = np.random.default_rng(seed)
        self.odd = draw.integers(1, 1 << 63, SUBSETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = np.array([64 - r.bit_length() + 1 for r in RATES for _ in range(PER_RATE)], np.uint64)

    def __call__(self, text: str) -> str:
        import xxhash

        found = terms(text)
        ids = set(map(self.within.__getitem__, found))
        ids.discard(0)
        if len(ids) < FEW:
            ids = set(map(_hash, found))
        t = np.fromiter(ids, np.uint64, len(ids))
        t.sort()
        mixed = (t ^ (t >> np.uint64(29)))[:, None] * self.odd[None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(GOLD)
        hit = (mixed >> self.shift[None, :]) == 0
        out = []
        for k in range(SUBSETS):
            some = t[hit[:, k]]
            out.append(f"{xxhash.xxh3_64_intdigest(some.tobytes()):016x}" if len(some) else ".")
        return "-".join(out)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = a.split("-"), b.split("-")
    best = 0.0
    for at in range(len(RATES) - 1, -1, -1):
        p, q = x[at * PER_RATE : (at + 1) * PER_RATE], y[at * PER_RATE : (at + 1) * PER_RATE]
        either = sum(i != "." or j != "." for i, j in zip(p, q, strict=True))
        both = min(sum(i != "." for i in p), sum(j != "." for j in q))
        if both >= 5 * PER_RATE / 8 or at == 0:
            best = sum(i == j != "." for i, j in zip(p, q, strict=True)) / either if either else 0.0
            break
    return best


def fingerprint(docs: DataFrame, lexicon: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    from pyspark.sql import types as T

    def work(batches):
        make = Fingerprints(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(len(keep)).to_pylist()
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array([make(t or "") for t in texts], pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(work, T.StructType([*(docs.schema[k] for k in keep), T.StructField("fingerprint", T.StringType())]))


def _bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ids that cut the documents into about equal ranges: at most parts - 1."""
    if parts < 2:
        return []
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / parts for k in range(1, parts)], 10000).alias("c")).first().c
    return sorted(set(cuts or []))


def with_next(docs: DataFrame, lexicon: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: of each document and
    of its text with the last quarter replaced by the start of the next document's, by ascending id.

    Documents are dealt out by ranges of ids, each a task of its own, compressed, and sorted within a range; the first
    documents of a range also go to the range before, so that every document meets its next."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // RANGE)
    cuts = np.array(_bounds(docs, id_col, parts), np.int64)

    def ranges(batches):
        for batch in batches:
            key = np.array([FIRST_KEY if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            at = np.searchsorted(cuts, key, "left")
            some = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.array([key[at == k].min() for k in some], np.int64))], names=["range", "first"])

    firsts = sorted((r.range, r.first) for r in docs.select(F.col(id_col).cast("long")).mapInArrow(ranges, "range int, first long").groupBy("range").agg(F.min("first").alias("first")).collect())  # a row a range
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    def dealt(batches):
        import xxhash
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    key, data = FIRST_KEY if i is None else i, (t or "").encode()
                    row = (key, i, xxhash.xxh3_64_intdigest(data) - (1 << 63), packer.compress(data))
                    rows.append((int(np.searchsorted(cuts, key, "left")), 0, *row))
                    if key in before:
                        rows.append((before[key], 1, *row))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["range", "tail", "key", "id", "hash", "data"])

    sent = spark.sparkContext.broadcast(lexicon)

    def work(batches):
        import zstandard

        make, opener = Fingerprints(sent.value), zstandard.ZstdDecompressor()
        held, place = None, None  # the document that waits for its next, and its range
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for place_, tail, i, data in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("range", "tail", "id", "data")), strict=True):
                    if tail and held is None:
                        continue
                    text = opener.decompress(data).decode()
                    mark = make(text)
                    if held is not None and place == place_:
                        own, t, f = held
                        n = len(t)
                        q = n // 4
                        edited = t[: n - q] + text[:q]
                        g = make(edited)
                        out.append((own, n, hashlib.sha256(edited.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, mark)))
                    held, place = (None, None) if tail else ((i, text, mark), place_)
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(dealt, "range int, tail int, key long, id long, hash long, data binary")
    met = rows.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "tail", "key", "hash")
    return met.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
