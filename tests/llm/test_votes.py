import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import common, quality, words

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
M32, M64 = 2**32, 2**64


def mixed(x):
    return int(words.mix(np.array([x % M64], np.uint64))[0])


def brute_terms(text):
    """Counts by term, and the numbers of trigrams and words, from plain loops."""
    raw, out = text.encode(), Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        key = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % M32
        out[((key ^ (key >> 15)) * 0x2C1B3C6D) % M32 >> 20] += 1
    said = [xxhash.xxh64_intdigest(w) for w in raw.lower().split()]
    for h in said:
        out[quality.LETTERS + (h >> 52)] += 1
    for g, h in zip(said, said[1:]):
        out[quality.TERMS - 1 if g == h else quality.LETTERS + (mixed(mixed(g) + h) >> 52)] += 1
    return out, max(0, len(raw) - 2), len(said)


TEXTS = ["", "a", "ab ab ab", "word " * 500, "é!! É!!", "", "x\ny x\ny", "The quick brown fox"]


@pytest.mark.parametrize("piece", [1 << 20, 7, 1])
def test_counts_match_plain_loops(piece):
    for texts in (pa.array(TEXTS), pa.array(["zz", *TEXTS, "q"]).slice(1, len(TEXTS))):
        x, sizes = quality.counts(texts, piece)
        for row, size, text in zip(x, sizes.tolist(), TEXTS):
            want, *n = brute_terms(text)
            assert {k: int(row[k]) for k in np.flatnonzero(row)} == dict(want) and size == n


def brute_scores(train, asked, dims=32, k=15, power=4, prior=0.01):
    """Scores of texts from a whole singular value decomposition and sorted lists of neighbours."""

    def row(text):
        terms, letters, said = brute_terms(text)
        out = np.zeros(quality.TERMS)
        for t, c in terms.items():
            out[t] = math.sqrt(c / (max(letters, 1) if t < quality.LETTERS else said + 20 if t == quality.TERMS - 1 else 2 * max(said, 1)))
        return out

    x = np.array([row(t) for t, _ in train])
    idf = np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) + 1
    unit = lambda v: v * idf / (np.linalg.norm(v * idf) + 1e-9)
    x = np.array([unit(v) for v in x])
    mean = x.mean(0)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2][:dims].T
    known = [(x_ - mean) @ axes for x_ in x]
    out = []
    for text in asked:
        z = unit(row(text)) - mean
        near = sorted(((z @ axes) @ v / np.linalg.norm(z) / np.linalg.norm(v), j) for j, v in enumerate(known))[::-1][:k]
        weight = [max(s, 0) ** power for s, _ in near]
        out.append((sum(w * train[j][1] for w, (_, j) in zip(weight, near)) + prior / 2) / (sum(weight) + prior))
    return out


def test_query_matches_brute_force(spark):
    docs = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    train = [(docs[d] or "", q) for d, q in labels if not held(d)]
    want = dict(zip(docs, brute_scores(train, [t or "" for t in docs.values()])))
    got = quality.op8_quality_votes(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=2e-3)
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_recall_of_both_classes(spark):
    rows = quality.op8_quality_votes(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    junk = [1 - r["predicted"] for r in rows if r["quality"] == 0]
    assert len(good) > 50 and len(junk) > 10
    assert sum(good) >= 0.95 * len(good) and sum(junk) >= 0.95 * len(junk)


def test_noise_of_the_same_shape_scores_lower(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    learn = common.crc_mod("doc_id", 3) != 1
    model = quality.fit(docs, labels, learn)
    good = [r["text"] for r in docs.join(labels, "doc_id").filter(~learn & (F.col("quality") == 1)).collect()]
    rng, scores = random.Random(1), model.scores(pa.array(good))
    for letters in ("qxzjvk", "abcdefghijklmnopqrstuvwxyz"):
        noise = [re.sub("[a-z]", lambda _: rng.choice(letters), t) for t in good]
        assert (model.scores(pa.array(noise)) < scores).mean() >= 0.95
    shuffled = ["".join(rng.sample(t, len(t))) for t in good]
    assert (model.scores(pa.array(shuffled)) < scores).mean() >= 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, "fine text here", "a"), (2, "BAD!! BAD!!", "b"), (2, "BAD!! BAD!!", "b"), (3, None, "c"), (None, "", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.scored(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(docs, quality.fit(docs, labels, F.lit(True), k=1))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1} and 2 not in {r["doc_id"] for r in kept.collect()}
    none = quality.fit(docs, labels.filter("false"), F.lit(True))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.filter("false"), model).count() == 0
    assert quality.fit(docs, labels, common.crc_mod("doc_id", 3) == 1) is not None


def test_any_column_names_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "fine text here " * 200_000, "a", 1, 2), (2, "x", "b", 1, 2)], "doc_id long, text string, `a.b` string, score int, extra_0 int")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, quality.fit(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns and kept.count() == 2
