import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import lm

SCHEMA = "doc_id long, text string, held boolean, block long"


def brute_scores(rows, mu=lm.MU):
    """Scores from plain dictionaries: (doc_id, held_out, n_tokens, n_known, N, base, score)."""
    split = [(d, h, [*bytes.lower((t or "").encode()).split(), b"\n"]) for d, t, h in rows]
    start, uni, bi, tri, ctx = b"\n\n", Counter(), Counter(), Counter(), Counter()
    for _, held, words in split:
        if not held:
            full = [start, *words]
            uni.update(words)
            bi.update(zip(full, words))
            tri.update(zip(full, words, words[1:]))
            ctx.update(full[:-1])
    total, types, out = sum(uni.values()), len(uni), []
    for doc_id, held, words in split:
        base, score, u, v = 0.0, 0.0, None, start
        for w in words:
            p = p1 = (uni[w] + 1) / (total + types + 1)
            p = (bi[v, w] + mu[0] * p) / (ctx[v] + mu[0])
            if u is not None and bi[u, v]:
                p = (tri[u, v, w] + mu[1] * p) / (bi[u, v] + mu[1])
            base, score, u, v = base + math.log10(p1), score + math.log10(p), v, w
        out.append((doc_id, held, len(words), sum(uni[w] > 0 for w in words), total, base, score))
    return out


def rows():
    rng = random.Random(6)
    words = ["The", "the", "CAT", "sat", "on", "é", "É", "mat", "x y"]
    out = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 30))) + rng.choice(["", " ", "\n"]), k % 4 == 1, 1) for k in range(90)]
    # bigrams and trigrams of one block alone, and of a training and a held-out block
    out += [(200 + k, f"only{k // 3} here{k // 3} twice{k // 3} the cat only{k // 3} here{k // 3} twice{k // 3}", k % 3 == 1, 1) for k in range(30)]
    return out + [(500, None, False, 1), (501, "", True, 1), (502, " \n", False, 1), (None, "the cat", False, 1), (7, "the cat", True, 1), (503, "new words " * 4000, True, 1)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "buckets": 3}, {"block_bytes": 60, "bucket_bytes": 100, "buckets": 1}])
def test_scores(spark, options):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = lm.lm_scores(frame, F.col("held"), **options).collect()
    want = brute_scores([r[:3] for r in data])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def automaton(text, mu=(7.0, 3.0)):
    """The automaton of all n-grams over the words of a text, and its tables."""
    words = text.split()
    vocabulary = sorted({*words, "<", ">"})
    full = ["<", *words, ">"]
    number = {w: k for k, w in enumerate(vocabulary)}
    pairs = [(a, b) for a in range(len(vocabulary)) for b in range(len(vocabulary))]
    c2, c3 = Counter(zip(full, full[1:])), Counter(zip(full, full[1:], full[2:]))
    triples = [(k, b * len(vocabulary) + c) for k, (a, b) in enumerate(pairs) for c in range(len(vocabulary))]
    c1 = np.array([full[1:].count(w) for w in vocabulary])
    contexts = np.array([full[:-1].count(w) for w in vocabulary])
    n2 = np.array([c2[vocabulary[a], vocabulary[b]] for a, b in pairs])
    n3 = np.array([c3[vocabulary[a], vocabulary[b], vocabulary[c]] for a, b in pairs for c in range(len(vocabulary))])
    made = lm.Automaton([c1, n2, n3], contexts, np.array(pairs).T, np.array(triples).T, len(full) - 1, int((c1 > 0).sum()), mu)
    return made, vocabulary, number


def test_arcs_of_a_state_and_its_failures_sum_to_one():
    made, vocabulary, number = automaton("a b a c a b b a c c a b")
    n = len(vocabulary)
    # the start is no token that follows; its place in the root holds what unknown tokens get
    for state in range(len(made.depth)):
        if made.depth[state] == 2 and not made.there[1][state - 1 - n]:
            continue  # no such state
        if made.depth[state] == 2 and (state - 1 - n) % n == number[">"]:
            continue  # nothing follows the end
        last = (state - 1 - n) % n if made.depth[state] == 2 else state - 1
        bigram = last * n if state else 0
        arcs = [np.arange(n), bigram + np.arange(n), (state - 1 - n if made.depth[state] == 2 else 0) * n + np.arange(n)]
        _, weight = made.step(np.full(n, state), arcs)
        assert (10.0**weight).sum() == pytest.approx(1), state


def test_the_state_is_carried_from_left_to_right():
    """Cutting a text into parts changes nothing, and each step goes to the longest suffix that was seen."""
    text = "a b a c a b b a c c a b d d a b a"
    made, vocabulary, number = automaton(text)
    n, full = len(vocabulary), [number[w] for w in ["<", *text.split(), ">"]]
    at, before = np.array(full[1:]), np.array(full[:-1])
    arc = before * n + at
    third = np.concatenate([[0], arc[:-1] * n + at[1:]])
    whole = made.traverse([at, arc, third], np.array([0]), np.array([len(at)]), 1 + number["<"], length=1000)
    for length in (3, 4, 7):
        assert np.allclose(whole, made.traverse([at, arc, third], np.array([0]), np.array([len(at)]), 1 + number["<"], length=length))
    state = np.array([1 + number["<"]])
    for k in range(len(at)):
        state, _ = made.step(state, [x[k : k + 1] for x in (at, arc, third)])
        assert state[0] == 1 + n + arc[k]


def test_all_held_out_and_empty(spark):
    got = lm.lm_scores(spark.createDataFrame(rows(), SCHEMA), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in got)
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA), F.lit(False)).count() == 0
