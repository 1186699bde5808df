"""Token ids packed into rows of a fixed length.

Documents longer than a row are split, without loss, into parts that say where they start. The parts of a
shard (up to SHARD tokens, read in order within one partition) are packed by best fit, longest first: each
goes to the row with the least room that still holds it, which a segment tree over amounts of room finds in
logarithmic time. A row has its ids (padded), the cumulative lengths of its segments, where positions start
again from 0, and per segment the document and the place of its first token in it. Memory is bounded by the
shard. The same partition gives the same rows, so a task that is run again writes what was lost.

Edge cases: a null or empty text has no tokens and is in no row; repeated rows are packed as often as they
occur; a null id is packed under a null; an empty table gives no rows; extra columns are ignored.

write puts rows into binary files, each a shard of up to ROWS rows: MAGIC, then as unsigned 32-bit integers the row
length, the rows, the bytes of an id (2 or 4) and the segments; then the matrix of ids, row by row; then, as unsigned
32-bit integers, where each row's segments begin among all (one more than rows), the cumulative lengths at which
segments end, and where their positions start again. All numbers are little-endian. A file is written under a name of
its own and then moved to its place, so that a task that is run again replaces it whole. The manifest, a Parquet table
beside the files, has a row for each with its counts and SHA-256; read checks files against it.
"""

from __future__ import annotations

import functools
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD, ROWS, MAGIC = 1_000_000, 4096, b"IDPACK01"
MANIFEST = "file string, rows int, length int, segments long, tokens long, id_bytes int, sha256 string"


class Rooms:
    """Which amounts of room, 0 to most, some row has: a segment tree in an array."""

    def __init__(self, most: int):
        self.leaf = 1 << most.bit_length()
        self.tree = bytearray(2 * self.leaf)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at, tree = room + self.leaf, self.tree
        while at and not tree[at]:
            tree[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room that is need or more, taken out: (room, row)."""
        tree, at = self.tree, need + self.leaf
        while not tree[at]:  # up, until a range to the right has any
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaf:
            at = 2 * at + (not tree[2 * at])
        room = at - self.leaf
        row = self.rows[room].pop()
        if not self.rows[room]:
            while at and not (at < self.leaf and (tree[2 * at] or tree[2 * at + 1])):
                tree[at] = 0
                at >>= 1
        return room, row


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of indexes of lengths (1 to most each), best fit, longest first; equal lengths in order."""
    rooms, rows = Rooms(most), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if got := rooms.take(lengths[i]):
            room, row = got
        else:
            room, row = most, len(rows)
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


@functools.lru_cache(2)
def _encoding(ranks_path_digest: str, pattern: str, ranks):
    import base64

    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}, special_tokens={})


class _Ranks:
    def __init__(self, path: str):
        import hashlib

        with open(path, "rb") as f:
            self.value = f.read()
        self.digest = hashlib.sha256(self.value).hexdigest()

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest


def pack(docs: DataFrame, ranks_path: str, pattern: str, length: int = 2048, pad: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (pack_id, n_tokens, ids, cu_seqlens, position_resets, doc_ids, starts) of the documents' tokens.
    The ranks file has the size of its vocabulary and is broadcast."""
    ranks = docs.sparkSession.sparkContext.broadcast(_Ranks(ranks_path))
    schema = f"pack_id string, n_tokens int, ids array<int>, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{docs.schema[id_col].dataType.simpleString()}>, starts array<int>"

    def work(batches):
        import numpy as np
        from pyspark import TaskContext

        encode = _encoding(ranks.value.digest, pattern, ranks.value).encode_ordinary
        part, shard = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def rows(held, shard):
            parts = [(d, at, ids[at : at + length]) for d, ids in held for at in range(0, len(ids), length)]
            packed = best_fit([len(p[2]) for p in parts], length)
            for lo in range(0, len(packed), 256):
                some = packed[lo : lo + 256]
                matrix = np.full((len(some), length), pad, np.int32)
                cu, resets, ids, starts, counts = [], [], [], [], []
                for k, row in enumerate(some):
                    ends = np.cumsum([len(parts[i][2]) for i in row])
                    matrix[k, : ends[-1]] = np.concatenate([parts[i][2] for i in row])
                    cu.append([0, *ends.tolist()])
                    resets.append([0, *ends[:-1].tolist()])
                    ids.append([parts[i][0] for i in row])
                    starts.append([parts[i][1] for i in row])
                    counts.append(int(ends[-1]))
                lists = lambda x: pa.array(x, pa.list_(pa.int32()))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * length, length, dtype=np.int32)), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{shard}-{lo + k}" for k in range(len(some))]), pa.array(counts, pa.int32()), flat, lists(cu), lists(resets), pa.array(ids, pa.list_(held_type[0])), lists(starts)],
                    names=["pack_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "starts"],
                )

        held_type = []
        for batch in batches:
            held_type[:] = [batch.schema.field(0).type]
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for d, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if text:
                        ids = np.array(encode(text), np.int32)
                        held.append((d, ids))
                        size += len(ids)
                        if size >= SHARD:
                            yield from rows(held, shard)
                            held, size, shard = [], 0, shard + 1
        if held:
            yield from rows(held, shard)

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def position_ids(cu_seqlens: str = "cu_seqlens") -> Column:
    """Positions within each segment of a packed row, without padding."""
    return F.expr(f"flatten(transform(sequence(1, size({cu_seqlens}) - 1), i -> sequence(0, {cu_seqlens}[i] - {cu_seqlens}[i - 1] - 1)))")


def unpacked(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids): the segments again, as they were split."""
    one = F.expr("explode(transform(sequence(1, size(cu_seqlens) - 1), i -> named_struct('doc_id', doc_ids[i - 1], 'start', starts[i - 1], 'ids', slice(ids, cu_seqlens[i - 1] + 1, cu_seqlens[i] - cu_seqlens[i - 1]))))")
    return packed.select(one.alias("s")).select("s.*")


def _store(uri: str):
    """The store and the path in it of a URI (file, hdfs, s3, gs, abfs ...) that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encoded(ids, cu_seqlens: list[list[int]], id_bytes: int) -> bytes:
    """A shard's bytes: ids, a matrix of integers, and the cumulative lengths of each of its rows."""
    import numpy as np

    ends = [np.asarray(c[1:], "<u4") for c in cu_seqlens]
    resets = [np.asarray(c[:-1], "<u4") for c in cu_seqlens]
    first = np.cumsum([0, *map(len, ends)]).astype("<u4")
    head = MAGIC + struct.pack("<4I", ids.shape[1], len(ids), id_bytes, int(first[-1]))
    return b"".join([head, ids.astype(f"<u{id_bytes}").tobytes(), first.tobytes(), *(e.tobytes() for e in ends), *(r.tobytes() for r in resets)])


def decoded(data: bytes):
    """(ids, first, ends, resets) of a shard, as arrays over its bytes."""
    import numpy as np

    if data[:8] != MAGIC:
        raise ValueError("not a shard of packed ids")
    length, rows, size, segments = struct.unpack_from("<4I", data, 8)
    at = 24 + length * rows * size
    whole = np.frombuffer(data, "<u4", rows + 1 + 2 * segments, at)
    if len(data) != at + 4 * len(whole):
        raise ValueError("a shard of packed ids is cut short")
    return np.frombuffer(data, f"<u{size}", length * rows, 24).reshape(rows, length), whole[: rows + 1], whole[rows + 1 : rows + 1 + segments], whole[rows + 1 + segments :]


def write(packed: DataFrame, uri: str, id_bytes: int = 4, rows: int = ROWS) -> DataFrame:
    """Writes what pack returns as binary files in the folder at uri, from the executors, and returns the manifest."""

    def work(batches):
        import hashlib
        import uuid

        import numpy as np
        from pyspark import TaskContext

        store, folder = _store(uri)
        store.create_dir(folder, recursive=True)
        part, count, held = TaskContext.get().partitionId(), 0, []

        def put():
            ids = np.concatenate([h[0] for h in held])
            cu = [c for h in held for c in h[1]]
            if id_bytes < 4 and len(ids) and int(ids.max()) >= 1 << 8 * id_bytes:
                raise ValueError(f"an id needs more than {id_bytes} bytes")
            data = encoded(ids, cu, id_bytes)
            name, rough = f"shard-{part:06d}-{count:06d}.bin", f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(rough) as out:
                out.write(data)
            store.move(rough, f"{folder}/{name}")
            row = (name, len(ids), ids.shape[1], sum(len(c) - 1 for c in cu), sum(c[-1] for c in cu), id_bytes, hashlib.sha256(data).hexdigest())
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                flat = some.column(0)
                held.append((flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1), some.column(1).to_pylist()))
                if sum(len(h[0]) for h in held) >= rows:
                    yield put()
                    held, count = [], count + 1
        if held:
            yield put()

    folder = f"{uri.rstrip('/')}/manifest"
    packed.select("ids", "cu_seqlens").mapInArrow(work, MANIFEST).write.mode("overwrite").parquet(folder)
    return packed.sparkSession.read.schema(MANIFEST).parquet(folder)


def read(spark, uri: str) -> DataFrame:
    """(file, row, n_tokens, ids, cu_seqlens, position_resets) of the files that write has put at uri."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri.rstrip('/')}/manifest")

    def work(batches):
        import hashlib

        store, folder = _store(uri)
        for batch in batches:
            for name, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{folder}/{name}") as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} is not what its manifest says")
                ids, first, ends, resets = decoded(data)
                cu = [[0, *ends[a:b].tolist()] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                back = [resets[a:b].tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids)), pa.array(range(len(ids)), pa.int32()), pa.array([c[-1] for c in cu], pa.int32()), pa.array(ids.astype("i4").tolist(), lists), pa.array(cu, lists), pa.array(back, lists)],
                    names=["file", "row", "n_tokens", "ids", "cu_seqlens", "position_resets"],
                )

    return manifest.select("file", "sha256").mapInArrow(work, "file string, row int, n_tokens int, ids array<int>, cu_seqlens array<int>, position_resets array<int>")
