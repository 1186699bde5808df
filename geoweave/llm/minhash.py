"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes the set of hashes of its word shingles; texts with equal sets form one node.
2. The HEAD smallest hashes of a node go to inverted lists. Hashes that one node alone holds link nothing
   and are dropped; of a node's others only the rarest are kept, as many as any partner must share one of
   (prefix filter on sketches). Of lists with the same nodes one stays.
3. Within each list, in blocks, a larger sketch (DEEP smallest hashes) of both sides gives the overlap and
   the estimate on the sketch of the union; a pair in several lists is looked at in the first. Pairs that the
   estimate can't rule out leave the task, less those that surer pairs of the same block connect already; where
   one of these surer pairs turns out to be no link, its block is gone through again without leaving any out.
4. Exact Jaccard on the full sets of these pairs, made again from the texts, confirms links.
5. Connected components by alternating star steps over the confirmed links.
6. Of a list longer than a block, one node of each component goes on, again in blocks, as long as that at least
   halves the list: a family of near copies, however large, soon is one component. Lists that do not shrink so
   have all pairs of their blocks compared, but for nodes that are connected by then.

Recall: two sets of the least similarity share fewer of HEAD smallest hashes than the mean less SPREAD
deviations with probability below 1e-7, and the estimate lies more than MARGIN deviations low with
probability near 1e-6. Sets of at most HEAD shingles share a list for certain if they are similar enough. The
larger sketch has codes of 32 bits, of which two of a set are equal with probability near 2e-4, whatever the
set's size; a set tells how many of its codes are equal, so that for sets of at most DEEP shingles the overlap is
never taken for too small.

Edge cases: null, empty and white-space texts have no shingles and stand alone; rows without id link
nothing, have no component and are kept; rows that repeat an id with the same text get the same answer,
all of them kept if the id is its component's; one id with different texts is as many nodes. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweave.llm.common import Bounded, forget, only, rows_of, stored, tidy

HEAD, DEEP, SPREAD, MARGIN, BLOCK, SENT = 32, 256, 6.0, 4.75, 1024, 100_000
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def _least(k: int, t: float) -> int:
    """Of the k smallest hashes of a union, how many two sets of similarity t share but for chance."""
    return max(1, math.floor(k * t - SPREAD * math.sqrt(k * t * (1 - t))))


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """Distinct shingle hashes of a text, ascending, as unsigned 64-bit integers."""

    def __init__(self, n: int):
        self.n, self.words = n, Bounded(_word_hash, 150_000)
        self.odd = np.array([MIX[i % len(MIX)] + 2 * (i // len(MIX)) for i in range(n)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out += h[i : len(h) - n + 1 + i] * self.odd[i]
            out ^= out >> np.uint64(29)
        out *= np.uint64(MIX[0])
        out ^= out >> np.uint64(32)
        out *= np.uint64(MIX[1])
        out ^= out >> np.uint64(29)
        return np.unique(out)


def _shingler(n: int) -> Shingler:
    return only(("shingler", n), lambda: Shingler(n))


def _codes(hashes: np.ndarray) -> np.ndarray:
    """Hashes as numbers of 32 bits in the same order: six tell the place of the highest bit, the others those that
    follow it, so that the small hashes of a large set stay apart as well as those of a small one."""
    upper = hashes >> np.uint64(11)  # a double holds these exactly
    high = np.frexp(upper.astype(np.float64))[1]
    right, left = (np.maximum(d, 0).astype(np.uint64) for d in (high - 27, 27 - high))
    return (high.astype(np.uint64) << np.uint64(26) | (upper >> right << left) & np.uint64((1 << 26) - 1)).astype("<u4")


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, n_shingles, node (digest of the whole set; null if empty), head (smallest hashes), deep (codes of more)."""

    def work(batches):
        make = _shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [make(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(min(DEEP, len(s)) for s in sets)])
                codes = _codes(np.concatenate([s[:DEEP] for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([s[:HEAD].view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([codes[a:b].tobytes() for a, b in itertools.pairwise(ends)], pa.binary()),
                    ],
                    names=[id_col, "n_shingles", "node", "head", "deep"],
                )
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_shingles long, node binary, head array<long>, deep binary")


def _lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(value, node, df): the inverted lists worth a look, with their lengths."""
    entries = nodes.select("node", F.least("n_shingles", F.lit(HEAD)).alias("k"), F.col("n_shingles").alias("n"), F.explode("head").alias("value"))
    # counted before any shuffle and joined, so that a value of very many nodes is nowhere a group in one task
    shared = entries.join(entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "value")
    # a partner holds at least so many of the k values; exact where a partner's values are all kept too
    least = F.when(F.col("n") > HEAD * percent / 100.0, F.lit(_least(HEAD, percent / 100))).otherwise(F.ceil(F.col("k") * percent / 100.0 - 1e-9))
    alone = F.col("k") - F.count("*").over(W.partitionBy("node"))
    rarest = F.row_number().over(W.partitionBy("node").orderBy("df", "value"))
    kept = stored(shared.withColumn("room", F.col("k") - least + 1 - alone).withColumn("at", rarest).where("at <= room").select("value", "node"), "lists")
    # lists of the same nodes: the count and two sums of hashes tell them apart
    wide = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    same = kept.groupBy("value").agg(F.count("*").alias("df"), wide(1).alias("a"), wide(2).alias("b")).where("df > 1").groupBy("df", "a", "b").agg(F.min("value").alias("value"))
    lists = stored(kept.join(same.select("value", "df"), "value"), "lists")
    forget(kept)
    return lists


def _shared(where: np.ndarray, owner: np.ndarray, m: int, cut: int, off: int) -> np.ndarray:
    """How many numbers of where, ascending and each once for an owner, the owners 0 ... cut - 1 have in common with
    each of off ... m - 1, those before them by number aside if off is 0."""
    out = np.zeros((cut, m - off), np.float32)
    if not len(where):
        return out
    values, at = np.unique(where, return_inverse=True)
    many = np.bincount(at)
    busy = np.flatnonzero(many > 8)
    column = np.full(len(values), -1, np.int64)
    column[busy] = np.arange(len(busy))
    place = column[at]
    for lo in range(0, len(busy), 1024):  # numbers of many owners: a matrix product
        part = (place >= lo) & (place < lo + 1024)
        x = np.zeros((m, min(1024, len(busy) - lo)), np.float32)
        x[owner[part], place[part] - lo] = 1
        out += x[:cut] @ x[off:].T
    few = (many[at] > 1) & (many[at] <= 8)  # numbers of few owners: one by one
    w, o = at[few], owner[few]
    for step in range(1, 8):
        same = np.flatnonzero(w[step:] == w[:-step]) if len(w) > step else np.zeros(0, np.int64)
        p, q = o[same], o[same + step]
        fit = (p < cut) & (q >= off)
        np.add.at(out, (p[fit], q[fit] - off), 1)
    return out


def _held(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (number, owner), in order."""
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = np.concatenate(parts)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], owner[new]


def _block_pairs(at: int, rows: list[tuple], percent: int, cross: bool, trust: bool) -> list[tuple[bytes, bytes, bool]]:
    """rows: side (0 or 1), node, size, deep sketch, places of the node, component, of one block or (cross) of two.
    Pairs that may be similar enough, are not of one component and have no place before at in common, where they are
    seen; with whether they are taken for certain, so that (trust) pairs that these connect are left out."""
    t = percent / 100
    rows = sorted(rows, key=lambda r: r[0])
    m = len(rows)
    # rows of the product and columns: all by all, or one block by the other
    cut = sum(r[0] == 0 for r in rows) if cross else m
    off = cut if cross else 0
    size = np.array([r[2] for r in rows], np.int64)
    sketches = [np.unique(np.frombuffer(r[3], "<u4")) for r in rows]
    held = np.array([len(s) for s in sketches])
    overlap = _shared(*_held(sketches), m, cut, off)
    before = [np.array([v for v in r[4] if v < at], np.int64) for r in rows]
    if any(map(len, before)):
        overlap[_shared(*_held(before), m, cut, off) > 0] = 0  # looked at there
    i, j = np.nonzero(overlap if cross else np.triu(overlap, 1))
    common = overlap[i, j]
    j += off
    number: dict = {}
    top = np.array([-1 - k if r[5] is None else number.setdefault(r[5], len(number)) for k, r in enumerate(rows)])
    ok = (np.minimum(size[i], size[j]) >= t * np.maximum(size[i], size[j]) - 1e-9) & (top[i] != top[j])
    i, j, common = i[ok], j[ok], common[ok]
    whole = (size[i] <= DEEP) & (size[j] <= DEEP)
    lost = np.minimum(size, DEEP) - held  # codes equal to another of their set
    most = common + np.minimum(lost[i], lost[j])
    sure = whole & (most >= t * (size[i] + size[j] - most) - 1e-6)
    likely = common / (size[i] + size[j] - common)
    # pairs stay arrays: a block of near copies has half a million of them
    parts = [(likely[sure], likely[sure] >= t - 1e-6, i[sure], j[sure])]
    due = _least(DEEP, t)
    open_ = ~whole & (most / (held[i] + held[j] - common) >= due / (2 * DEEP - due))
    i, j = i[open_], j[open_]
    shares, certain = np.full(len(i), -1.0), np.zeros(len(i), bool)
    for k in range(len(i)):
        a, b = int(i[k]), int(j[k])
        u = np.union1d(sketches[a], sketches[b])[:DEEP]
        both = np.intersect1d(sketches[a], sketches[b], assume_unique=True)
        share = np.searchsorted(both, u[-1], "right") / len(u)
        union = max(len(u), (int(size[a]) + int(size[b])) / (1 + t))
        slack = MARGIN * math.sqrt(t * (1 - t) / len(u) * max(0.0, 1 - len(u) / union)) + 1 / len(u)
        if share >= t - slack:
            shares[k], certain[k] = share, share >= t + slack
    ok = shares >= 0
    parts.append((shares[ok], certain[ok], i[ok], j[ok]))
    share, certain, i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((-share, ~certain))
    group = list(range(m))

    def of(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for k in order:
        a, b = int(i[k]), int(j[k])
        x, y = of(a), of(b)
        if x != y:
            out.append((min(rows[a][1], rows[b][1]), max(rows[a][1], rows[b][1]), bool(certain[k])))
            if certain[k] and trust:
                group[x] = y
    return out


def _compared(cells: DataFrame, nodes: DataFrame, percent: int, trust: bool) -> DataFrame:
    """(a, b, certain, cell): pairs of nodes, a < b. cells: cell, cross, at (its place in the order in which pairs are
    seen), side, node, top (its component or null)."""
    mine = cells.groupBy("node").agg(F.collect_set("at").alias("places"))  # HEAD at most
    full = cells.join(nodes.select("node", "n_shingles", "deep").join(mine, "node"), "node")

    def work(batches):
        only("blocks", list)  # no memo beside a block
        key, at, cross, held = None, 0, False, []

        def done():
            return [(*p, key) for p in _block_pairs(at, held, percent, cross, trust)] if len(held) > 1 else []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.bool_(), pa.int64()))], names=["a", "b", "certain", "cell"])

        for batch in batches:
            out = []
            for cell, place, both, side, node, size, deep, places, top in rows_of(batch, ["cell", "at", "cross", "side", "node", "n_shingles", "deep", "places", "top"], 2048):
                if cell != key:
                    out += done() if key is not None else []
                    key, at, cross, held = cell, place, both, []
                held.append((side, node, size, deep, places, top))
            if out:
                yield batch_of(out)
        if key is not None and (out := done()):
            yield batch_of(out)
        held = []
        tidy()

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(work, "a binary, b binary, certain boolean, cell long")


def _own_cells(lists: DataFrame, turn: int) -> DataFrame:
    """Cells of the blocks of lists (value, node, df, and top)."""
    blocks = F.ceil(F.col("df") / BLOCK)
    cell = F.when(blocks > 1, F.xxhash64("value", F.pmod(F.xxhash64("node", "value", F.lit(turn)), blocks))).otherwise(F.col("value"))
    return lists.select(cell.alias("cell"), F.lit(False).alias("cross"), cell.alias("at"), F.lit(0).alias("side"), "node", "top")


def _cross_cells(lists: DataFrame) -> DataFrame:
    """Cells of all pairs of different blocks of lists; the blocks are those of the first turn, which has seen the
    pairs within them."""
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    members = lists.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "value", F.lit(0)), F.col("blocks")).cast("int"))
    met = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).where("own <> other")
    cell = F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other"))
    return met.select(cell.alias("cell"), F.lit(True).alias("cross"), F.col("value").alias("at"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "top")


def _links(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, lists: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Enough of the links (a, b) to connect what all of them would, and the components (node, top) of those of the
    turns before the last."""

    def linked(cells: DataFrame, few: bool = True) -> DataFrame:
        pairs = stored(_compared(cells, nodes, percent, True), "pairs")
        links = _confirmed(docs, id_col, text_col, nodes, pairs.select("a", "b").distinct(), words, percent, few)
        wrong = pairs.where("certain").join(links, ["a", "b"], "left_anti").select("cell").distinct()
        if not wrong.isEmpty():
            more = stored(_compared(cells.join(wrong, "cell", "left_semi"), nodes, percent, False), "pairs")
            links = links.union(_confirmed(docs, id_col, text_col, nodes, more.select("a", "b").distinct(), words, percent, True))
            forget(more)
        forget(pairs)
        return links

    links = linked(_own_cells(lists.withColumn("top", F.lit(None).cast("binary")), 0), False)
    wide = stored(lists.where(F.col("df") > BLOCK).withColumn("was", F.col("df")), "wide")
    tops, turn = None, 0
    while not wide.isEmpty():
        tops, turn = components(links if tops is None else links.union(tops.select("node", "top"))), turn + 1
        met = wide.join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
        some = stored(met.groupBy("value", "top").agg(F.min("node").alias("node")), "some")
        left = some.groupBy("value").agg(F.count("*").alias("now")).where("now > 1")
        left = stored(wide.groupBy("value").agg(F.max("was").alias("was")).join(left, "value"), "left")
        shrinks = (F.col("was") > BLOCK) & (2 * F.col("now") <= F.col("was"))
        again, rest = left.where(shrinks).drop("was"), left.where(~shrinks).select("value")
        links = links.where(F.lit(False))  # not a list of Python's, for which executors would start more workers
        if not again.isEmpty():
            links = links.union(linked(_own_cells(some.join(again.withColumnRenamed("now", "df"), "value"), turn)))
        if not rest.isEmpty():
            links = links.union(linked(_cross_cells(met.join(rest, "value", "left_semi"))))
        wide = stored(wide.drop("was").join(again.withColumnRenamed("now", "was"), "value"), "wide")
    return links, tops


def _confirmed(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, pairs: DataFrame, n: int, percent: int, few: bool) -> DataFrame:
    """The pairs whose full sets, made again from the texts, are similar enough. few: there may be so few that their
    ids are sent to the texts."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct().join(nodes.select("node", F.col(id_col).alias("some")), "node")
    if few:
        ends = stored(ends, "ends")
        if ends.count() <= SENT:
            ends = F.broadcast(ends)

    def sets(batches):
        make = _shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                full = [make(t) for t in part.column(1).to_pylist()]
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(full, part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() if y else None for s, y in zip(full, same, strict=True)], pa.binary())], names=["node", "full"])
        tidy()

    # an id may stand for several texts and a text may be repeated: one row of each node stays
    whole = docs.select(F.col(id_col).alias("some"), F.col(text_col).alias("t")).join(ends, "some").select("node", "t").mapInArrow(sets, "node binary, full binary").where("full is not null")
    held = stored(whole, "sets")
    whole = held.dropDuplicates(["node"])
    met = pairs.join(whole.select(F.col("node").alias("a"), F.col("full").alias("p")), "a").join(whole.select(F.col("node").alias("b"), F.col("full").alias("q")), "b")

    def check(batches):
        for batch in batches:
            out = []
            for a, b, p, q in rows_of(batch, ["a", "b", "p", "q"]):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    links = stored(met.mapInArrow(check, "a binary, b binary"), "links")
    forget(held)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, top): for each node of the links (a, b) the smallest node that it reaches. Alternating star
    steps: neighbours above a node move to its smallest neighbour, then those below do, until nothing moves."""
    names = links.columns
    edges = stored(links.select(F.greatest(*names).alias("u"), F.least(*names).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        forget(edges)
        edges = moved
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            tops = stored(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("top")), "tops")
            forget(edges)
            return tops
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id that links reach, or its own), kept."""
    signed = stored(_signed(docs, id_col, text_col, words), "signed")
    named = signed.where(F.col("node").isNotNull() & F.col(id_col).isNotNull())
    # of each node the row with its smallest id
    nodes = stored(named.groupBy("node").agg(F.min(F.struct(F.col(id_col), "n_shingles", "head", "deep")).alias("x")).select("node", "x.*"), "nodes")
    links, before = _links(docs, id_col, text_col, nodes, _lists(nodes, percent), words, percent)
    tops = components(links if before is None else links.union(before.select("node", "top")))
    ids = nodes.select("node", F.col(id_col).alias("least")).join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    best = ids.groupBy("top").agg(F.min("least").alias("best"))
    answer = ids.join(best, "top").select("node", "best")
    own = F.col(id_col)
    out = signed.select(id_col, "n_shingles", F.when(own.isNotNull(), F.col("node")).alias("node")).join(answer, "node", "left")
    component = F.least(own, F.col("best"))
    return out.select(own, "n_shingles", F.when(own.isNotNull(), component).alias("component_id"), F.coalesce(own == component, F.lit(True)).alias("kept"))
