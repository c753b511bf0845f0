import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import common, jaccard, words
from folio.llm.components import components

SCHEMA = "doc_id long, text string, n int, gid long"


def shingles(text):
    w = bytes.lower((text or "").encode()).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets)), key=repr)


def rows(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    out = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.choice([4, 5, 8, 9, 30, 80, 200]))
        if base % 3 == 0:
            text = text + passage
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(text)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(0, len(copy))
                copy[at : at + rng.randrange(0, 2)] = rng.choices(vocabulary, k=rng.randrange(0, 2)) if len(copy) > 1 else copy[at : at + 1]
            out.append(" ".join(copy))
    # a chain whose ends are far apart
    chain = rng.choices(vocabulary, k=100)
    for k in range(8):
        out.append(" ".join(chain[6 * k : 6 * k + 60]))
    out += ["", None, " \n\t", "That it.", "that IT.", "THAT it .", "é É", "é é", "long words here " * 3000]
    rng.shuffle(out)
    return [(k * 3, t, 1, 1) for k, t in enumerate(out)] + [(4, "That it.", 1, 1), (3, "two texts of one id with words", 1, 1), (None, "That it.", 1, 1)]


def test_shingle_sets():
    texts = [r[1] or "" for r in rows()]
    assert [len(s) for s in words.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"frequent_from": 2, "bucket_tokens": 300}), (3, {"tries": 0, "bucket_tokens": 10**9}), (4, {"frequent_from": 10**9})])
def test_components_match_brute_force(spark, seed, options):
    data = rows(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(data, SCHEMA).repartition(3), **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(data)


def test_hubs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "hub_bound", lambda rows: 1)
    data = rows(7)
    got = jaccard.jaccard_components(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(data)


def test_components_of_nulls_loops_and_repeated_edges(spark):
    edges = [(1, 2), (1, 2), (2, 1), (3, 3), (None, 4), (5, None)] + [(10, k) for k in range(11, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, **dict.fromkeys(range(10, 300), 10)}


def test_threshold_is_exact():
    a = np.arange(7, dtype=np.uint64)
    assert jaccard.linked(a[:3], a[:4], 75) and not jaccard.linked(a[:2], a[:3], 75)
    assert jaccard.linked(a, a, 75) and not jaccard.linked(a[:0], a[:0], 75)


def test_near_dedup(spark):
    data = rows(5)
    keep = {r[2] for r in brute(data)}
    got = jaccard.near_dedup(spark.createDataFrame(data, SCHEMA))
    assert got.columns == ["doc_id", "text", "n", "gid"] and {r["doc_id"] for r in got.collect()} == keep


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 1), (20, 21), (21, 22), (22, 20), (30, 30)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys((1, 3, 5, 9), 1), **dict.fromkeys((20, 21, 22), 20), **dict.fromkeys(range(100, 141), 100)}


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_with_the_smaller_of_sizes_31_and_32(spark):
    """24 of 25 and 24 of 31 shingles are a link, also where the set of 31 has one of 32 beside it."""
    data = []
    for k in range(20):
        rng = random.Random(k)
        some = lambda m: [f"w{rng.randrange(10**6)}" for _ in range(m)]  # noqa: E731, B023
        passage = some(28)
        b = passage + some(7)
        texts = [passage + some(1), b, b + some(1), *(some(60) + passage for _ in range(6))]
        data += [(100 * k + j, " ".join(t), 1, 1) for j, t in enumerate(texts)]
    got = jaccard.jaccard_components(spark.createDataFrame(data, SCHEMA).repartition(1), frequent_from=3).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(data)


def test_can_link_loses_no_size(spark):
    """The bound for sizes low..high holds wherever it holds for one of the sizes, in both forms."""
    assert jaccard.can_link(1, 25, 10, 31, 32, 5, 5, 75)
    cases = [(s, nq, 10, low, high, 5, 5) for s in (1, 2, 4) for nq in (9, 24, 25, 40) for low in range(6, 50, 3) for high in range(low, low + 6)]
    want = [any(bool(jaccard.can_link(s, nq, a, n, n, b, c, 75)) for n in range(low, high + 1)) for s, nq, a, low, high, b, c in cases]
    assert [bool(jaccard.can_link(*case, 75)) for case in cases] == want
    names = ("shared", "nq", "last", "low", "high", "last_low", "last_high")
    columns = spark.createDataFrame(cases, ", ".join(f"{n} long" for n in names)).select(*names, jaccard.can_link(*(F.col(n) for n in names), 75).alias("ok"))
    assert {tuple(r)[:7]: r["ok"] for r in columns.collect()} == dict(zip(cases, want))


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(jaccard, "BLOCK_QUERIES", 2)
    data = rows(8)
    got = jaccard.jaccard_components(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(data)


@pytest.mark.parametrize("blocks", [4, 1 << 30])
def test_texts_of_candidates(spark, blocks):
    """Candidates' texts by bitmap and by shuffle; the driver gets a row for 512 ids and not one for each id."""
    from folio.llm.jaccard import _texts_of

    ids = [(p << 32) + k for p in (0, 1, 2**30) for k in range(3000)] + [None]
    texts = spark.createDataFrame([(r, f"t{r}") for r in ids], "rid long, text string")
    want = [r for r in ids if r is not None and (r % 7 == 0 or r & 63 == 63)]
    wanted = spark.createDataFrame([(r,) for r in want * 2 + [None]], "rid long")
    found = _texts_of(texts, wanted, 1 << 30, blocks)
    assert sorted(tuple(r) for r in found.collect()) == sorted((r, f"t{r}") for r in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastExchange" in plan and "block" in plan) == (blocks == 4)


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    """Spark's own broadcasts stay small whatever its threshold is: it goes by the size of files, not of rows."""
    from folio.llm import common

    key, seen, write = "spark.sql.autoBroadcastJoinThreshold", set(), common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: seen.add(df.sparkSession.conf.get(key)) or write(df, name))
    was = spark.conf.get(key)
    data = rows(3)
    found = jaccard.jaccard_components(spark.createDataFrame(data, SCHEMA))
    assert seen == {str(common.BROADCAST_BYTES)} and spark.conf.get(key) == was
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == brute(data)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    with common.small_broadcasts(spark):
        spark.conf.set(key, "-1")
        with common.small_broadcasts(spark):
            assert spark.conf.get(key) == "-1"
        spark.conf.set(key, "256k")
    assert spark.conf.get(key) == was
