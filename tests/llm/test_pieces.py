import hashlib
import struct
import weakref

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from geoweave.llm import minhash  # noqa: E402
from geoweave.llm.pieces import Pieces, _Model, digests, encode_decode  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
with open(PATH, "rb") as f:
    OWN = Pieces(f.read(), memo=500)


def ids(text):
    b = OWN.encode(text)
    return list(struct.unpack(f"<{len(b) // 4}I", b))


pieces = st.sampled_from([" ", "  ", "\n", " \n", "▁", "a", "er", "the", "aaa", "é", "漢", "😀", "\t", "00", "...", "\x00", "ing", "tion", "===", "\r"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(pieces, max_size=30).map("".join), st.text(max_size=40)))
def test_like_the_library(text):
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids(text) == want
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 258), st.integers(0, 31999)), max_size=8))
def test_decodes_any_ids(some):
    assert OWN.decode(struct.pack(f"<{len(some)}I", *some)) == LIBRARY.decode(some)


def test_long_runs():
    for text in ("ab" * 3000, "a" * 3001, " " * 777 + "x", "=" * 800):
        assert ids(text) == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_query(spark, odd, empty):
    rows = digests(encode_decode(odd, PATH)).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        want = LIBRARY.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want).encode()).hexdigest()
    assert digests(encode_decode(empty, PATH)).count() == 0


def test_a_process_holds_one_model_at_a_time():
    """Python workers outlive stages: the model of one goes when the next begins."""
    held = weakref.ref(_Model(PATH).load())
    assert held() is not None and _Model(PATH).load() is held()
    shingler = minhash._shingler(5)
    assert minhash._shingler(5) is shingler
    assert held() is None
