import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm.common import Workspace
from tablewright.llm.subwords import Encoder, TextEncoder
from tablewright.llm.token_output import (
    WaveletMatrix, default_tokenizer, read_shard, read_token_shards, token_frequencies, token_occurrences, token_output,
    tokens_at, write_shard, write_token_shards,
)

public_tokenizers = pytest.importorskip("public_tokenizers")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def expected(rows):
    t, start, out = tokenizer(), 0, []
    for i, text in sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_equals_the_tokenizer(documents, odd_rows):
    rows = [(i, t[:20_000] if t else t, *rest) for i, t, *rest in odd_rows]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output(documents(rows), tokenizer_path=default_tokenizer()).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)


ALPHABET = [
    " ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\u2003", "\x85", "\x1f", "a", "b", "'s", "'", "1", "é", "à", "Ñ", "<|endoftext|>", "<|",
    "中", "🙂", "!", "|", "xxxxx", "\0", "ta", "50€", "½",
]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)] + [None, ""]


def pieces(encoder, texts):
    out = []
    for ids, counts in encoder.ids(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("plain", [False, True])
def test_chunk_by_chunk_equals_whole(name, plain):
    encoder, texts = TextEncoder(public_tokenizers.path(name), plain=plain), random_texts(20_000)
    expected = [x.tolist() for x in encoder.encoder.each([t or "" for t in texts])]
    assert encoder.encoder.cuts == (name == "byte_bpe_50k.json")
    assert pieces(encoder, texts) == expected == pieces(encoder, texts)
    assert encoder.counts(pa.array(texts)).tolist() == [len(x) for x in expected]


def test_table_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr("tablewright.llm.subwords.KEPT_CHUNKS", 5)
    monkeypatch.setattr("tablewright.llm.subwords.BLOCK", 40)
    encoder, texts = TextEncoder(default_tokenizer()), random_texts(300, 2)
    assert pieces(encoder, texts) == [x.tolist() for x in encoder.encoder.each([t or "" for t in texts])]


def test_unknown_kinds_of_tokenizer_are_not_cut(tmp_path):
    import json

    spec = json.load(open(default_tokenizer()))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(spec))
    encoder, texts = TextEncoder(str(tmp_path / "lower.json")), ["Aa B", "\n X"]
    assert not encoder.encoder.cuts
    assert pieces(encoder, texts) == [x.tolist() for x in Encoder(default_tokenizer()).each([t.lower() for t in texts])]


def test_small_shards_and_order(spark, documents):
    rows = [(i * 7 % 50, f"text number {i}", "en", "a") for i in range(50)]
    shards = write_token_shards(documents(rows), Workspace(spark, "test"), tokenizer_path=default_tokenizer(), shard_tokens=9)
    assert shards.count() > 10
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_shards(shards).collect()]
    assert sorted(got) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 512, 513, 5000, 600_000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 40, n).astype(np.uint16) * 1613
    keys, lengths, m = read_shard(write_shard([1, None], [n, 0], ids))
    assert keys == [1, None] and lengths.tolist() == [n, 0] and (m.to_ids() == ids).all()
    for i in range(0, n, 37 + n // 50):
        v = int(ids[i])
        assert m.access(i) == v and m.rank(v, i // 2, n) == int((ids[i // 2:] == v).sum())
        assert m.select(v, int((ids[:i] == v).sum())) == i
        assert m.occurrences(v).tolist() == np.flatnonzero(ids == v).tolist()
    assert m.rank(65535, 0, n) == int((ids == 65535).sum()) and m.select(3, 0) == -1


def test_damage_is_noticed():
    data = bytearray(write_shard([1], [3], np.array([1, 2, 3], np.uint16)))
    data[24] ^= 1
    with pytest.raises(ValueError):
        read_shard(bytes(data))


def test_planes_are_built_in_order():
    zeros, ranks, planes = WaveletMatrix.build(np.array([1 << 15, 0, 1 << 15, 1], np.uint16))
    assert zeros[0] == 2 and planes[0] == bytes([0b10100000]) and ranks[0].tolist() == [0, 2]


def test_ids_beyond_the_planes_raise():
    with pytest.raises(ValueError):
        write_shard([1], [1], np.array([70_000], np.uint32))


def test_answers_over_all_shards(spark, documents, odd_rows):
    rows = [(i, t[:3000] if t else t, *rest) for i, t, *rest in odd_rows]
    shards = write_token_shards(documents(rows), Workspace(spark, "test"), tokenizer_path=default_tokenizer(), shard_tokens=200).cache()
    t = tokenizer()
    texts = [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x, *_ in rows]
    wanted = [0, 11, 262, 13, 60_000, 70_000]
    n = {r.token: r.n for r in token_frequencies(shards, wanted).collect()}
    assert n == {w: sum(ids.count(w) for _, ids in texts) for w in wanted} and n[0] >= len(rows)
    found = sorted((r.token, r.doc_id or -1, r.offset) for r in token_occurrences(shards, wanted).collect())
    assert found == sorted((x, i or -1, k) for i, ids in texts for k, x in enumerate(ids) if x in wanted)
    places = [(2, 0), (2, 5), (1, 3), (7, 999), (7, 10**7), (3, 0), (3, 1), (99, 0), (None, 0), (8, -1)]
    got = sorted((r.doc_id, r.offset, r.token) for r in tokens_at(shards, spark.createDataFrame(places, "doc_id long, offset long")).collect())
    assert got == sorted((i, k, ids[k]) for i, k in places for j, ids in texts if i is not None and i == j and 0 <= k < len(ids))


def test_empty_table(documents):
    assert token_output(documents([]), tokenizer_path=default_tokenizer()).collect() == []
