import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folio.llm import packing, wavelet
from folio.llm.tokens import PieceEncoder

DOCS = [
    (3, "a b  c\n\n d é ́ it's 'S", 9),
    (1, None, 9),
    (2, "", 1),
    (7, "word " * 5000, 1),
    (7, "<|endoftext|> </s> x　 y\t\tz", 1),
    (None, "no id", 2),
    (5, "same text", 2),
    (6, "same text", 2),
    (8, "\0abc def \0", 2),
]


def frame(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, part int")


def ids_of(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


#: What texts of the library comparison are made of: U+0000, control strings, signs, marks, letters that change when composed.
BITS = ["\0", "a", "ab", "The", "it's", " ", "  ", "\n", "\t", "!", "..", "é", "e\u0301", "\u0301", "中", "▁", "<|endoftext|>", "<|startoftext|>", "</s>", "1", "23", "=", "\u0338", "'S", "\x1f", "\x85", "Ǆ", "İ", "ſt", "\ufb2a", "\u0958", "\u212a", "ß"]


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("literal", [False, True])
def test_ids_are_the_librarys(name, spaced, literal):
    rng = random.Random(5)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(9))) for _ in range(8000)] + ["\0abc def", "\0", "a \0b", "say <|endoftext|> now"]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = literal
    encoder = PieceEncoder(public_tokenizers.path(name), spaced, literal)
    ids, at = encoder.encode(pa.array(texts))
    assert encoder.cuts and [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_are_encoded_whole(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = {"type": "Replace", "pattern": {"String": "a b"}, "content": "c"}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    texts = ["a b a b", "", "plain"]
    encoder = PieceEncoder(path, True)
    ids, at = encoder.encode(pa.array(texts))
    assert not encoder.cuts and [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_wavelet_access_rank_select():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (700, 2), (5000, 49407), (1300, 100_000)):
        a = rng.integers(0, top, n, endpoint=True)
        m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.image(a, [4, None], np.array([n, 0])))
        assert m.symbols().tolist() == a.tolist() and m.doc_ids == [4, None] and m.doc_lengths.tolist() == [n, 0]
        for i in range(0, n, 97):
            assert m.access(i) == a[i]
            assert m.rank(int(a[i]), i) == int((a[:i] == a[i]).sum())
            assert m.select(int(a[i]), int((a[:i] == a[i]).sum())) == i
            assert m.count(int(a[i])) == int((a == a[i]).sum())
        assert m.count(1 << 30) == 0
        with pytest.raises(IndexError):
            m.access(n)


def test_a_look_up_opens_a_frame_or_two_of_each_plane():
    a = np.random.default_rng(4).integers(0, 49408, 600_000)
    image = wavelet.WaveletMatrix.image(a, [1], np.array([len(a)]))
    for i in (0, 131_071, 131_072, 400_001, 599_999):
        m = wavelet.WaveletMatrix(image)
        assert m.access(i) == a[i] and sum(isinstance(k, tuple) for k in m._open) <= 2 * m.levels
        assert m.rank(int(a[i]), i) == int((a[:i] == a[i]).sum()) and m.select(int(a[i]), int((a[:i] == a[i]).sum())) == i
        assert m.count(int(a[i])) == int((a == a[i]).sum())
    assert (m.symbols() == a).all()


@pytest.mark.parametrize("shard_tokens", [7, 1 << 20])
def test_shards_read_back(spark, tmp_path, shard_tokens):
    path = str(tmp_path / "shards")
    wavelet.write_shards(frame(spark), public_tokenizers.path("word_bpe_49k.json"), path, shard_tokens=shard_tokens)
    rows = wavelet.read_shards(spark, path).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 5, 6, 7, 7, 8]
    start = 0
    want = {(d, tuple(ids_of("word_bpe_49k.json", t) + [1])) for d, t, _ in DOCS}
    got = set()
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == start
        start += len(ids)
        got.add((r["doc_id"], tuple(ids.tolist())))
    assert got == want


def test_shards_of_an_empty_table(spark, tmp_path):
    wavelet.write_shards(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "none"))
    assert wavelet.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_fullest_is_a_best_subset():
    rng = np.random.default_rng(5)
    for _ in range(40):
        counts = np.zeros(41, np.int64)
        for size in rng.integers(1, 41, 5):
            counts[size] += 1
        target = int(rng.integers(1, 41))
        sums = {0}
        for size in range(1, 41):
            for _ in range(int(counts[size])):
                sums |= {s + size for s in sums}
        got = packing.fullest(target, counts, 40)
        assert sum(s * k for s, k in got) == max(s for s in sums if s <= target)
        assert all(k <= counts[s] for s, k in got)


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(packing.cut_pieces(frame(spark), path)).collect()
    want = set()
    for d, t, _ in DOCS:
        ids = ids_of("byte_bpe_50k.json", t) + [0]
        head = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want |= {(d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows} == want
    assert len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r["length"] for r in rows) // 2048)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(packing.cut_pieces(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
