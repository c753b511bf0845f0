import random
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import sentence

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, key int, chunk int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


LATTICE = sentence.Lattice(MODEL)


def by_chunks(text, size):
    s = sentence.mark(text)
    chunks = [sentence.Chunk(LATTICE, s, 0, a, min(a + size, len(s)), len(s)) for a in range(0, len(s), size)]
    matrices = [(c.entries, c.matrix) for c in chunks]
    states = sentence.crossings(matrices, sentence.START, sentence.last_state(reduce(sentence.combine, matrices), len(s)))
    opened = [sentence.Chunk.opened(LATTICE, s, 0, c.first, c.trail()) for c in chunks]
    return [i for c, a, b in zip(opened, states, states[1:]) for i in c.trace(a, b)], matrices


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeinrst hélo wnd.,'\n▁中文ab  xX01", min_size=1, max_size=60), st.integers(1, 30))
def test_scan_gives_the_librarys_ids(text, size):
    assert by_chunks(text, size)[0] == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)


def test_scan_of_long_runs():
    rng = random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("a" * 500, "ab" * 300, "".join(rng.choices("etaoins", k=700)), " " * 100, "the cat sat " * 50, "=" * 333):
        for size in (7, 64, 1000):
            assert by_chunks(text, size)[0] == library.encode(text)


def test_combination_is_associative():
    _, m = by_chunks("internationalisation of the unbelievable", 6)
    left = reduce(sentence.combine, m)
    right = reduce(lambda acc, x: sentence.combine(x, acc), reversed(m[:-1]), m[-1])
    assert left[0] == right[0] and sorted(left[1]) == sorted(right[1])


def test_encode_and_decode(spark, library):
    rows = [(1, "plain text  here", 0, 0), (2, None, 0, 0), (3, "", 0, 0), (4, " lead and trail ", 0, 0), (5, "a\n\nb\té 中▁x", 0, 0), (6, "long wordsandruns " * 400 + "z" * 300, 0, 0), (6, "twice", 0, 0), (None, "no id", 0, 0), (7, "\0abc def\0 \0", 0, 0), (8, "\0 x" * 200, 0, 0)]
    # chunks of 8 take three levels of combination
    for giant, chunk in ((100, 64), (100, 8), (1, 4), (1 << 16, 64)):
        some = rows if chunk != 4 else [r for r in rows if len(r[1] or "") < 200]
        got = sentence.decode(sentence.encode(spark.createDataFrame(some, SCHEMA), MODEL, giant=giant, chunk=chunk), MODEL).collect()
        assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=repr) == sorted(((d, library.encode(t or "")) for d, t, *_ in some), key=repr)
        assert sorted((r["text"] for r in got)) == sorted((t or "").replace("▁", " ") for _, t, *_ in some)
    assert sentence.decode(sentence.encode(spark.createDataFrame([], SCHEMA), MODEL), MODEL).count() == 0


def test_other_models_encode_whole_documents(spark, tmp_path):
    model = sentence.read_model(MODEL)
    assert sentence.scannable(model)
    model.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "other.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    assert not sentence.scannable(sentence.read_model(path))
    rows = [(1, "  two   blanks  ", 0, 0), (2, "wide  gaps " * 30, 0, 0)]
    got = sentence.encode(spark.createDataFrame(rows, SCHEMA), path, giant=20, chunk=16).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {d: library.encode(t) for d, t, *_ in rows}
