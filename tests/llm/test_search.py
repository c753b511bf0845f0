import math

import numpy as np
from pyspark.sql import functions as F

from folio.llm import search

SCHEMA = "vec_id long, embedding array<float>, label int, cell int"


def brute(rows, k):
    ok = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for i, q in ok:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)
            out |= {(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])}
    return out


def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 16)) / 4
    out = [(i, (centres[i % 5] + rng.normal(size=16) / 30).tolist(), 0, 1) for i in range(400)]
    out += [(i, out[0][1], 0, 1) for i in range(400, 460)]  # many ties
    bad = [(500, None, 0, 1), (501, [0.5] * 15 + [float("nan")], 0, 1), (502, [float("inf")] * 16, 0, 1), (503, [None] * 16, 0, 1), (None, [9.0] * 16, 0, 1)]
    return out + bad + [(504, [3.0, 1.0], 0, 1), (505, [], 0, 1), (520, [4.0] * 3, 0, 1)]


def test_top_k(spark):
    data = rows()
    vectors = search.quantise(spark.createDataFrame(data, SCHEMA))
    for part_rows, cell_rows, block in ((1 << 17, 8192, 128), (100, 30, 3)):
        got = search.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20, part_rows=part_rows, cell_rows=cell_rows, block=block).collect()
        assert {tuple(r) for r in got} == brute(data, 20) and len(got) == len(brute(data, 20))


def clustered(size):
    rng = np.random.default_rng(2)
    return (np.repeat(rng.normal(size=(40, 8)) * 400, size // 40, 0) + rng.normal(size=(size, 8)) * 4).astype(np.int64)


def test_elimination_skips_far_candidates():
    x = clustered(4000)
    frame = search.fitting_frame(x[::7], 5)
    cell = search.Cell(np.arange(4000), x, frame)
    queries = search.Queries(np.arange(50), x[:50], np.full(50, -(2**63)), frame, 5)
    evaluated = cell.search(queries)
    for query, (ids, scores) in enumerate(queries.found):
        exact = x @ x[query]
        exact[query] = exact.min() - 1
        assert ids.tolist() == np.lexsort((np.arange(4000), -exact))[:5].tolist() and scores.tolist() == exact[ids].tolist()
    assert evaluated < 50 * 4000 * 0.1


def test_floors_are_carried_from_cell_to_cell():
    x = clustered(4000)
    order = np.random.default_rng(3).permutation(4000)
    frame = search.fitting_frame(x[::7], 5)
    cells = [search.Cell(order[a : a + 500], x[order[a : a + 500]], frame) for a in range(0, 4000, 500)]
    run = lambda carried: sum(c.search(carried()) for c in cells)
    fresh = lambda: search.Queries(np.arange(50), x[:50], np.full(50, -(2**63)), frame, 5)
    one = fresh()
    assert run(lambda: one) < run(fresh)


def test_bounds_hold_and_are_no_weaker_than_single_pivots():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-64, 64, (300, 12)), rng.integers(-64, 64, (20, 12))
    for count in (0, 1, 5, 12):
        frame = search.Frame(search.choose_pivots(x, count))
        got = search.bounds(frame.measured(q), frame.measured(x))
        assert (got >= q @ x.T).all()
        far = [search.pivot_table(v, frame.pivots) for v in (q, x)]
        low = np.abs(far[0][:, None] - far[1][None]).max(2)
        single = ((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - low**2) / 2
        assert (got <= single + 1e-4 * np.abs(single) + 2).all()
    assert np.allclose(got, q @ x.T, rtol=1e-3, atol=2)  # as many pivots as dimensions leave no doubt


def test_pivots_of_poor_samples():
    assert len(search.choose_pivots(np.zeros((5, 3), np.int64), 4)) == 0
    assert len(search.choose_pivots(np.array([[1, 2, 3], [2, 4, 6], [0, 0, 0]]), 4)) == 1
    assert len(search.fitting_frame(np.zeros((0, 3), np.int64), 4).pivots) == 0


def test_large_components_stay_exact():
    big = np.array([[2**40, 3], [2**31, 5]], np.int64)
    assert search.products(big, big[:1])[:, 0].tolist() == [2**63 - 1, 2**71 + 15 if 2**71 < 2**63 else 2**63 - 1]


def test_fewer_than_k_and_none(spark):
    few = search.quantise(spark.createDataFrame([(0, [1.0], 0, 1), (1, [2.0], 0, 1)], SCHEMA))
    assert [tuple(r) for r in search.top_k(few, few.filter("vec_id = 0"), 20).collect()] == [(0, 1, 1, 64 * 128)]
    none = search.quantise(spark.createDataFrame([], SCHEMA))
    assert search.top_k(none, none, 20).count() == 0
