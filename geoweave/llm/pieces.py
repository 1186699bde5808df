"""SentencePiece encoding and decoding (merge-type models).

Encoding goes by backtracking: an Aho-Corasick automaton over the reversed pieces gives the longest piece
that starts at each position; a piece may follow another only if merging the two afresh would leave them
apart; a position from which no piece leads on is marked in a bitfield and never tried again.

White space becomes U+2581. Where no piece holds that sign behind another character, and none holds a line
feed, no merge crosses such a place, so a text is the sequence of its words and each distinct word is
encoded once and kept in a bounded memo. Characters outside the vocabulary become byte pieces.

Edge cases: a null or empty text has the begin and end ids only and decodes to the empty text; rows are
independent of each other, so repeated rows and extra columns pass through as they are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweave.llm.common import Bounded, only, tidy

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """A merge-type model: its pieces, their merge order, and encode and decode."""

    def __init__(self, model: bytes, memo: int = 200_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback, a leading space and no other normalisation are supported")
        if bad := {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"unsupported kinds of pieces: {sorted(bad)}")
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[proto.pieces[i].score] for p, i in self.ids.items()}
        self.known = {c for c in self.ids if len(c) == 1}
        if any(not self.known.issuperset(p) for p in self.ids):
            raise ValueError("a piece holds a character that is no piece")
        self.by_word = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self._splits()
        self._automaton()
        unk = proto.trainer_spec.unk_surface
        self.surface = [unk.encode() if p.type == UNKNOWN else b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.quick = [b"\xff" if k == CONTROL else x for x, k in zip(self.surface, self.kinds, strict=True)]  # inside a text, a control piece parts byte pieces
        self.four = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.words = Bounded(self._word, memo)
        self.fits = Bounded(self._fits, memo + memo // 2)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merges neighbours plainly, best score first, then leftmost: the parts, and the last two merged."""
        parts, last, rank = list(text), None, self.rank
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _splits(self) -> None:
        """The last merge of each piece that merging can make. odd: pieces whose merges are not made in the order of rank."""
        self.split: dict[str, tuple[str, str]] = {}
        self.odd: set[str] = set()
        ties: dict[int, int] = {}
        for r in self.rank.values():
            ties[r] = ties.get(r, 0) + 1
        for p in sorted(self.ids, key=len):
            if len(p) == 1:
                continue
            parts, last = self.merge(p)
            if parts == [p]:
                self.split[p] = last
                if ties[self.rank[p]] > 1 or any(x in self.odd or len(x) > 1 and self.rank[x] >= self.rank[p] for x in last):
                    self.odd.add(p)

    def _automaton(self) -> None:
        import ahocorasick

        auto = ahocorasick.Automaton()
        made = [*self.known, *self.split]
        held = set(made)
        self.shorter = {}
        for p in made:
            auto.add_word(p[::-1], p)
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in held), "")
        auto.make_automaton()
        self.auto = auto

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether merging the two pieces' characters afresh ends in these two pieces."""
        a, b = pair
        if a in self.odd or b in self.odd:
            return self.merge(a + b)[0] == [a, b]
        rank, split, limit = self.rank, self.split, None
        while True:
            across = rank.get(a + b)
            if across is not None and (limit is None or across < limit):
                return False
            late_a = rank[a] if len(a) > 1 else -1
            late_b = rank[b] if len(b) > 1 else -1
            if late_a < 0 and late_b < 0:
                return True
            if late_a > late_b:  # the later merge is undone; of equal ones the left was first
                limit, a = late_a, split[a][1]
            else:
                limit, b = late_b + 1, split[b][0]  # at equal rank the merge across is further left

    def _run(self, text: str) -> list[str]:
        """Pieces of a text of known characters."""
        if text in self.split or len(text) == 1:
            return [text]
        n = len(text)
        # at each end the automaton gives the longest match first, so that the last of the reversed list is the longest
        longest = dict(reversed(list(self.auto.iter(text[::-1]))))
        top = n - 1
        failed = bytearray((n >> 3) + 1)
        out, at, piece, fits, shorter = [], 0, longest[top], self.fits, self.shorter
        while at < n:
            last = out[-1] if out else ""
            while True:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not last or fits[last, piece]):
                    out.append(piece)
                    at = end
                    piece = longest[top - end] if end < n else ""
                    break
                piece = shorter[piece]
                if not piece:
                    failed[at >> 3] |= 1 << (at & 7)
                    out.pop()
                    at -= len(last)
                    piece = last
                    break
        return out

    def _encoded(self, text: str) -> bytes:
        """Ids of a text in which white space is escaped already."""
        known, out, at = self.known, [], 0
        if known.issuperset(text):
            return b"".join([self.four[p] for p in self._run(text)])
        while at < len(text):
            if text[at] in known:
                end = at + 1
                while end < len(text) and text[end] in known:
                    end += 1
                out += [self.four[p] for p in self._run(text[at:end])]
                at = end
            else:
                out += [self.byte_ids[x].to_bytes(4, "little") for x in text[at].encode()]
                at += 1
        return b"".join(out)

    def _word(self, key: str) -> bytes:
        """key: a word; spaces before it stand for white space beyond the one that precedes any word but those after a line feed."""
        return self._encoded(key.replace(" ", SPACE) if key.lstrip(" ")[:1] == "\n" else SPACE + key.replace(" ", SPACE))

    def encode(self, text: str | None) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        first, last = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        if not text:
            return first + last
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.by_word:
            return first + self._encoded(SPACE + text.replace(" ", SPACE)) + last
        words = text.replace("\n", " \n").split(" ")
        if "" in words:
            spaced, run = [], 0
            for w in words:
                if w:
                    spaced.append(" " * run + w)
                    run = 0
                else:
                    run += 1
            if run:  # a white-space word; its first sign is added by _word
                spaced.append(" " * (run - 1))
            words = spaced
        return b"".join((first, *map(self.words.__getitem__, words), last))

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian unsigned 32-bit integers): the leading space goes, runs of byte
        pieces are read as UTF-8, and each byte that is none becomes U+FFFD."""
        numbers = memoryview(ids).cast("I")
        quick, kinds = self.quick, self.kinds
        lo, hi = 0, len(numbers)
        while lo < hi and kinds[numbers[lo]] == CONTROL:
            lo += 1
        while lo < hi and kinds[numbers[hi - 1]] == CONTROL:
            hi -= 1
        if lo == hi:
            return ""
        whole = b"".join(map(quick.__getitem__, numbers[lo:hi]))
        try:
            return (whole.removeprefix(b" ") if kinds[numbers[lo]] == NORMAL else whole).decode()
        except UnicodeDecodeError:
            return self._decode_slowly(numbers)

    def _decode_slowly(self, numbers) -> str:
        out, held, first = [], b"", True

        def flush(held: bytes) -> str:
            text, at = [], 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        text.append(held[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    at += 1
            return "".join(text)

        for i in numbers:
            if self.kinds[i] == BYTE:
                held += self.surface[i]
                continue
            if held:
                out.append(flush(held))
                held, first = b"", False
            text = self.surface[i].decode()
            if first and text and self.kinds[i] == NORMAL:
                text = text.removeprefix(" ")
            first = first and not self.surface[i]
            out.append(text)
        return "".join(out) + flush(held)


class _Model:
    """A broadcast model file, equal to another if the file is (the file has a fixed size, given by the vocabulary)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.digest, self.value = hashlib.sha256(data).hexdigest(), data

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest

    def load(self) -> Pieces:
        return only(("pieces", self.digest), lambda: Pieces(self.value))


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded text."""
    model = df.sparkSession.sparkContext.broadcast(_Model(model_path))
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def work(batches):
        pieces = model.value.load()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [pieces.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([pieces.decode(x) for x in ids], pa.string())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )
        tidy()

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and decoded text, from what encode_decode returns."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
