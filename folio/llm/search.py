"""Exact top-k search by pivot-table elimination (operator 4).

Vectors are quantised to integers. Each candidate carries its distances to a number of pivots, the origin among
them. Distances to pivots fix where a vector lies in the pivots' span and how far from it, so two rows of the table
give the largest lower bound of their distance that the pivots allow (it is never below the largest difference of
two pivot distances), and with it an upper bound of their inner product. Candidates are dealt to partitions. A
query visits each partition once, goes through its cells with its k best so far, and in each cell evaluates
candidates in the order of their bounds until the next bound is below its k-th score: what is never evaluated cannot
enter the top k. Every query begins with the k-th score that it has among the sample of which the pivots are
chosen; their number is the one of least measured work within that sample. Both affect speed alone.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or
candidate; an empty vector scores 0; vectors of different lengths are compared over the shorter one; rows with
a null vec_id take no part; rows that share a vec_id are candidates of their own but never of a query with
that id; scores beyond 63 bits are held at the limit; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import common

HITS = "query_id long, vec_id long, score long"
#: Components beyond this are compared with Python integers: float products would not be exact.
EXACT = 1 << 20


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vec array<long>) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vec"))


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """int64 rows of `dim` components, short vectors filled with 0."""
    n, lens = len(lists), np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if n and (lens == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim), np.int64)
    out[np.repeat(np.arange(n), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with those of q, as int64."""
    if not x.size or not q.size or max(np.abs(x).max(), np.abs(q).max()) <= EXACT:
        return (x.astype(float) @ q.astype(float).T).astype(np.int64)
    exact = x.astype(object) @ q.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots in independent directions: each the vector of the sample farthest from the span of those before it."""
    rest, picked = sample.astype(float), []
    far = (rest**2).sum(1)
    tiny = 1e-9 * far.max() if len(far) else 0
    while len(far) and len(picked) < count and far.max() > tiny:
        at = int(far.argmax())
        picked.append(at)
        direction = rest[at] / np.linalg.norm(rest[at])
        rest = rest - np.outer(rest @ direction, direction)
        far = (rest**2).sum(1)
    return sample[picked].astype(float)


def pivot_table(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from each vector to the origin and to each pivot."""
    x = vectors.astype(float)
    sq = (x**2).sum(1)
    far = sq[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(np.concatenate([sq[:, None], far], 1), 0))


class Frame:
    """The pivots, and where their distances place a vector."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.sq = (pivots**2).sum(1)
        # a vector's products with the pivots are L times its coordinates in an orthonormal frame of their span
        self.solve = np.linalg.inv(np.linalg.cholesky(pivots @ pivots.T)).T if len(pivots) else np.zeros((0, 0))

    def place(self, table: np.ndarray) -> np.ndarray:
        """Rows of coordinates in the span, and last the distance from it, of rows of a pivot table."""
        norm = table[:, :1] ** 2
        inside = (norm + self.sq[None] - table[:, 1:] ** 2) / 2 @ self.solve
        return np.concatenate([inside, np.sqrt(np.maximum(norm - (inside**2).sum(1, keepdims=True), 0))], 1)

    def measured(self, vectors: np.ndarray) -> np.ndarray:
        return self.place(pivot_table(vectors, self.pivots))


def bounds(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of placed vectors: inside the span as they are, beyond it at most parallel."""
    top = max(np.abs(asked).max(initial=0), np.abs(held).max(initial=0))
    kind = np.float32 if top < 1e15 else np.float64
    size = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(held, axis=1)[None]
    out = asked.astype(kind) @ held.T.astype(kind)
    out += (2e-5 * size + 0.5).astype(kind)  # rounding of the table and of these products
    return out


def fitting_frame(sample: np.ndarray, k: int, tried: int = 64) -> Frame:
    """The frame whose number of pivots costs least, by the share of the sample's pairs it leaves to evaluate."""
    dim = sample.shape[1]
    pivots, queries = choose_pivots(sample, dim), sample[:: max(1, len(sample) // tried)][:tried]
    best, least = Frame(pivots[:0]), np.inf
    if len(sample) <= k:
        return best
    scores = products(sample, queries).T
    floor = np.partition(scores, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
    for count in sorted({max(1, len(pivots) * part // 8) for part in range(1, 9)} if len(pivots) else ()):
        frame = Frame(pivots[:count])
        left = (bounds(frame.measured(queries), frame.measured(sample)) >= floor[:, None]).sum() / len(queries)
        # a product of gathered rows costs some times that of a block
        cost = len(sample) * count + 4.0 * left * dim
        if cost < least:
            best, least = frame, cost
    return best


class Queries:
    """A block of queries with their k best so far, best first. A floor is a score that the k-th reaches."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, frame: Frame, k: int):
        self.ids, self.x, self.floors, self.k = ids, vectors, floors.copy(), k
        self.placed = frame.measured(vectors)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.floors[i]) & (ids != self.ids[i])
        if not keep.any():
            return
        names, values = np.concatenate([self.found[i][0], ids[keep]]), np.concatenate([self.found[i][1], scores[keep]])
        best = np.lexsort((names, -values))[: self.k]
        self.found[i] = names[best], values[best]
        if len(best) == self.k:
            self.floors[i] = max(self.floors[i], values[best[-1]])


class Cell:
    """Candidates with their pivot table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, frame: Frame):
        self.ids, self.x, self.placed = ids, vectors, frame.measured(vectors)

    def search(self, queries: Queries, first: int = 64) -> int:
        """Evaluate what can be among the queries' best, in the order of the bounds; the number of evaluations."""
        bound, evaluated = bounds(queries.placed, self.placed), 0
        for i in range(len(queries.ids)):
            mine = bound[i]
            open_ = np.flatnonzero(mine >= queries.floors[i])
            order = open_[np.argsort(-mine[open_], kind="stable")]
            at, size = 0, first
            while at < len(order) and mine[order[at]] >= queries.floors[i]:
                some = order[at : at + size]
                queries.add(i, self.ids[some], products(self.x[some], queries.x[i : i + 1])[:, 0])
                at, size = at + len(some), size * 2
            evaluated += at
        return evaluated


def _floors(sample: np.ndarray, names: np.ndarray, dim: int, k: int):
    """Queries with the k-th score that they have among the sample, which their k-th of all reaches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            floors = np.full(len(ids), -(2**63), np.int64)
            if len(sample) > k and len(ids):
                scores = products(sample, q).T
                # the query itself may be in the sample: of any k + m scores, m of them its own, the k-th of the others
                own = names[None] == ids[:, None]
                scores = np.where(own, -(2**63), scores)
                floors = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors, pa.int64())], ["vec_id", "vec", "floor"])

    return run


def _search(frame: Frame, dim: int, k: int, cell_rows: int, block: int):
    """Rows of a partition, candidates before queries -> each query's best in the partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cells, held = None, [], []

        def close():
            ids, vectors = (np.concatenate(c) for c in zip(*held))
            cells.extend(Cell(ids[a : a + cell_rows], vectors[a : a + cell_rows], frame) for a in range(0, len(ids), cell_rows))
            held.clear()

        for batch in batches:
            parts, asking = batch.column(0).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            names, x, floors = batch.column(1).to_numpy(), matrix(batch.column(2), dim), batch.column(3).fill_null(0).to_numpy()
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(asking.astype(int)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(parts)]):
                if a == b:
                    continue
                if parts[a] != part:
                    part, cells, held = parts[a], [], []
                if not asking[a]:
                    held.append((names[a:b], x[a:b]))
                    if sum(len(h[0]) for h in held) >= cell_rows:
                        close()
                    continue
                if held:
                    close()
                for c in range(a, b, block):
                    some = slice(c, min(c + block, b))
                    queries = Queries(names[some], x[some], floors[some], frame, k)
                    for cell in cells:
                        cell.search(queries)
                    sizes = [len(f[0]) for f in queries.found]
                    columns = [np.repeat(queries.ids, sizes), *(np.concatenate(v) for v in zip(*queries.found))]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, part_rows: int = 1 << 17, cell_rows: int = 8192, block: int = 128, sample: int = 2048) -> DataFrame:
    """For each row of queries (vec_id, vec) its k best of vectors: query_id, rank, vec_id, score.

    The pivots are chosen from `sample` vectors, which only affects speed; every vector is searched."""
    spark = vectors.sparkSession
    shape = vectors.agg(F.max(F.size("vec")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim, n = max(shape["dim"] or 0, 1), shape["n"]
    # enough partitions for the cluster, and none with more than some tens of MB of candidates
    parts = max(1, -(-n // part_rows), min(2 * spark.sparkContext.defaultParallelism, -(-n // 2048)))
    some = vectors.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(sample).select("vec_id", "vec").toArrow().combine_chunks()
    lists = some.column("vec").combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.int64()))
    known, names = matrix(lists, dim), some.column("vec_id").to_numpy()
    frame = fitting_frame(known, k)
    candidates = vectors.select(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(parts)).cast("int").alias("part"), "vec_id", "vec", F.lit(None).cast("long").alias("floor"))
    begun = queries.select("vec_id", "vec").mapInArrow(_floors(known, names, dim, k), "vec_id long, vec array<long>, floor long")
    asked = begun.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "vec", "floor")
    dealt = candidates.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("part", F.col("floor").isNotNull())
    hits = dealt.mapInArrow(_search(frame, dim, k, cell_rows, block), HITS)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
