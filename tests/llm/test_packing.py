import base64
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402

from geoweave.llm.packing import best_fit, pack, position_ids, read, unpacked, write  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_best_fit():
    draw = random.Random(2)
    for _ in range(200):
        most = draw.choice([1, 2, 3, 7, 8, 100, 2048])
        sizes = [draw.randint(1, most) for _ in range(draw.randint(0, 150))]
        rows = best_fit(sizes, most)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in r) <= most for r in rows)
        room = []
        for s in sorted(sizes, reverse=True):
            fits = [(x, k) for k, x in enumerate(room) if x >= s]
            if fits:
                room[min(fits)[1]] -= s
            else:
                room.append(most - s)
        assert len(room) == len(rows)


def test_round_trip(spark, odd, empty):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    packed = pack(odd, PATH, public_tokenizers.PATTERN, length=64).cache()
    got = {}
    for r in unpacked(packed).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    for d, text in {r.doc_id: r.text for r in odd.collect() if r.text and r.doc_id != 1}.items():
        assert [i for _, ids in sorted(got[d]) for i in ids] == enc.encode_ordinary(text)
    assert len(got[1]) == 2  # the repeated row
    for r in packed.select("*", position_ids().alias("p")).collect():
        assert len(r.ids) == 64 and r.cu_seqlens[-1] == r.n_tokens == len(r.p)
        assert all(x == 50256 for x in r.ids[r.n_tokens :])
        assert r.position_resets == r.cu_seqlens[:-1] == [i for i, x in enumerate(r.p) if x == 0]
    assert pack(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_binary_files(spark, odd, empty, tmp_path):
    packed = pack(odd, PATH, public_tokenizers.PATTERN, length=64).cache()
    want = sorted((r.n_tokens, r.ids, r.cu_seqlens, r.position_resets) for r in packed.collect())
    for size in (2, 4):
        uri = f"file://{tmp_path}/{size}"
        manifest = write(packed, uri, id_bytes=size, rows=100).collect()
        assert sum(m.rows for m in manifest) == len(want) and max(m.rows for m in manifest) <= 200 and len(manifest) > 3
        assert sum(m.tokens for m in manifest) == sum(w[0] for w in want) and {(m.length, m.id_bytes) for m in manifest} == {(64, size)}
        assert sorted((r.n_tokens, r.ids, r.cu_seqlens, r.position_resets) for r in read(spark, uri).collect()) == want
        # written again, files take the place of those before
        assert {m.file for m in write(packed, uri, id_bytes=size, rows=100).collect()} == {m.file for m in manifest}
        assert {f.name for f in (tmp_path / str(size)).glob("*.bin")} == {m.file for m in manifest} and not list((tmp_path / str(size)).glob(".*"))
    name = min(m.file for m in manifest)
    data = (tmp_path / "4" / name).read_bytes()
    (tmp_path / "4" / name).write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(Exception, match="not what its manifest says"):
        read(spark, uri).collect()
    with pytest.raises(Exception, match="more than 1 bytes"):
        write(packed, f"file://{tmp_path}/1", id_bytes=1).collect()
    assert write(pack(empty, PATH, public_tokenizers.PATTERN), f"file://{tmp_path}/none").count() == 0
    assert read(spark, f"file://{tmp_path}/none").count() == 0
