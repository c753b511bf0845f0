"""Best-fit packing by minimum bin slack (operator 7).

Documents are encoded and cut into pieces of at most `capacity` tokens. Only the histogram of piece lengths
(at most `capacity` counters, whatever the input) decides the plan: for each bin pattern the longest length left
is placed, a bitset subset-sum program over the lengths left finds the fullest feasible rest, and the pattern
is removed as often as the counts allow. A piece finds its place from its length and its rank among pieces of
that length; ranks are counted within each written partition and shifted by the partitions before it, so no
group of equal lengths meets in one task.

Defined results: null text counts as empty (one piece, the end id); a text of any length is packed whole; rows
that share a doc_id, or have none, are packed each on its own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.tokens import encoder

PIECE_SCHEMA = "part int, doc_id long, piece int, start long, length int, rank long, ids binary"
#: Offset rows (partition, length, pieces before) up to which they are broadcast, 24 bytes each; beyond, a shuffle join.
BROADCAST_ROWS = 400_000


def _cut(path: str, end_id: int, capacity: int, read_bytes: int, literal: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(path, True, literal=literal)
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for batch in common.byte_slices(batches, "text", read_bytes):
            got, at = enc.encode(batch.column(1))
            n = np.diff(at) + 1
            ends = np.cumsum(n)
            full = np.full(len(got) + len(n), end_id, "<u4")
            keep = np.ones(len(full), bool)
            keep[ends - 1] = False
            full[keep] = got
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n - (pieces - 1) * capacity  # the first piece may be shorter
            length = np.where(piece == 0, head[doc], capacity)
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            order = np.argsort(length, kind="stable")
            runs = length[order]
            first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
            within = np.arange(len(runs)) - np.repeat(first, np.diff(np.concatenate([first, [len(runs)]])))
            rank = np.empty(len(runs), np.int64)
            rank[order] = seen[runs] + within
            np.add.at(seen, length, 1)
            cuts = np.concatenate([[0], np.cumsum(length)]) * 4
            ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(full)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), part, np.int32)), batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32)), pa.array(rank), ids],
                ["part", "doc_id", "piece", "start", "length", "rank", "ids"],
            )

    return run


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, read_bytes: int = 4_000_000, literal: bool = False) -> DataFrame:
    """Encoded pieces of docs (doc_id, text), written to the shared folder so that ranks stay as they were counted.

    `literal`: strings of added tokens in a text are ordinary text and not that token."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return common.materialize(rows.mapInArrow(_cut(vocabulary, end_id, capacity, read_bytes, literal), PIECE_SCHEMA), "pieces")


def fullest(target: int, counts: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Lengths with multiplicities, within counts and none over `longest`, whose sum comes closest to target from below."""
    mask, goal = (1 << (target + 1)) - 1, 1 << target
    reach, steps = 1, []
    for size in range(min(target, longest), 0, -1):
        k = min(int(counts[size]), target // size)
        if k:
            steps.append((size, k, reach))
            shifted = reach
            for _ in range(k):
                shifted = (shifted << size) & mask
                if not shifted & ~reach:
                    break
                reach |= shifted
            if reach & goal:
                break
    total, out = reach.bit_length() - 1, []
    for size, k, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total, used = total - size, used + 1
        if used:
            out.append((size, used))
    return out


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram: [(bins, [(length, pieces of it in each bin)])]."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out, longest = [], capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        rest = dict(fullest(capacity - longest, counts, longest))
        counts[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        bins = min(int(counts[size]) // k for size, k in rest.items())
        for size, k in rest.items():
            counts[size] -= bins * k
        out.append((bins, sorted(rest.items(), reverse=True)))


def _places(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int):
    """(length, rank) -> (sequence, offset) from the plan, whose size is bounded by the capacity and not by the input."""
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    used, base = np.zeros(capacity + 1, np.int64), 0
    for bins, pattern in patterns:
        offset = 0
        for length, k in pattern:
            entries.setdefault(length, []).append((int(used[length]), base, k, offset))
            used[length] += bins * k
            offset += length * k
        base += bins
    tables = {length: np.array(rows, np.int64).T for length, rows in entries.items()}

    def locate(lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            first, bin0, k, shift = (c[np.searchsorted(tables[length][0], ranks[at], "right") - 1] for c in tables[length])
            sequence[at] = bin0 + (ranks[at] - first) // k
            offset[at] = shift + (ranks[at] - first) % k * length
        return sequence, offset

    return locate


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with sequence_id and offset: as few sequences as minimum bin slack finds, each gapless from 0."""
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = common.materialize(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    locate = _places(plan(histogram, capacity), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = counts.select("part", "length", before.alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = locate(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    rows = pieces.join(before, ["part", "length"]).withColumn("place", place("length", F.col("rank") + F.col("before")))
    return rows.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "place.sequence_id", "place.offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return packed_digest(common.table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


def packed_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    packed = pack(cut_pieces(docs, vocabulary))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
