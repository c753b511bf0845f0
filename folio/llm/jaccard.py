"""N-gram Jaccard join with a token-group matrix (operator 6).

Sets are distinct word shingles as 64-bit hashes; two documents link at a Jaccard similarity of 0.75 or more.

1. Documents with the same least shingle (under one permutation) meet in sorted ranges of partitions, so that a
   key with any number of documents spreads over tasks. There, equal sets become one class, and classes whose
   similarity to a leader is verified form its group. A group is connected by construction.
2. The token-group matrix holds, by token, the groups whose union of prefixes has it. Prefixes are taken in one
   global order (rare tokens first): two sets that link share a token of their prefixes. Classes that share no
   token are done. In a first reading each class asks only for one central class of each of its tokens, a row per
   cell at most; classes that meet one often
   are of its family. Members are compared with the central class that they meet most, and those outside the part
   of the family that this links with the whole family, in blocks.
3. In the second reading the groups of a component are one. Each class of the smaller component of a pair counts
   its prefix tokens in the other's union, its own family apart; the count bounds the overlap with every member,
   and only components whose bound reaches the threshold are opened, again in blocks. Components of groups give
   those of documents.

Nothing is capped: the limits on leaders tried in step 1 and the first reading of step 2 only decide which groups
form; step 3 finds every link between groups.

Defined results: null text counts as empty; texts without words have an empty set and link with nothing; rows
that share a doc_id are one node of the graph; a row with a null doc_id links with nothing and has a null
component_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.components import components
from folio.llm.words import mix, shingle_sets

TEXTS = "rid long, doc_id long, n int, gk long, text string, stats binary"
GROUPED = "kind int, rid long, doc_id long, n int, cid long, gid long, leader boolean, last long, bucket long, cells binary"
WEIGHTS = "cid long, shares long, weight long"
STARS = "q long, s long, shared int, nq int"
RENAMED = "part long, bucket long, cells binary"
EDGES = "u long, v long"
MATRIX = "q long, gq long, g long, shared int, nq long, last long, low long, high long, last_low long, last_high long"
#: Tokens of the list that goes last in the order, 16 bytes each; which tokens are in it affects speed alone.
FREQUENT = 1 << 17
#: Members of a group that are opened together, and queries that they are compared with in a task: members' whole
#: sets are held at once, and a group of any size spreads over tasks.
BLOCK_MEMBERS = BLOCK_QUERIES = 128
#: Rows of the bitmap of candidates up to which it is broadcast, some hundred bytes each for up to 512 ids; beyond, a
#: shuffle join. Ids are dense within a part, so that this is reached at some 16 million documents.
BROADCAST_BLOCKS = 1 << 15


def need(n, percent: int):
    """Least overlap with a set of n from either side alone: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common_ = int((both[1:] == both[:-1]).sum())
    return 100 * common_ >= percent * (len(a) + len(b) - common_)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as compressed byte planes, each behind its length."""
    out = [len(a).to_bytes(4, "little") + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else bytes(4) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(raw: bytes, dtypes: list) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for dtype in dtypes:
        n, size = int.from_bytes(data[at : at + 4], "little"), np.dtype(dtype).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at + 4).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += 4 + n * size
    return out


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> set sizes and least shingles; at the end, the tokens that occur more than once in the task."""
    common.free_worker()
    part, seq, fresh, held, repeated = TaskContext.get().partitionId(), 0, [], 0, []

    def count():
        """Of the tokens gathered, those of more than one document."""
        nonlocal fresh, held
        tokens = np.concatenate(fresh)
        tokens.sort()
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(tokens)]]))
        repeated.append((tokens[starts[counts > 1]], counts[counts > 1]))
        fresh, held = [], 0

    for batch in common.byte_slices(batches, "text", 4_000_000):
        sets, n = shingle_sets(batch.column(1)), batch.num_rows
        least = np.array([mix(s ^ np.uint64(0x51ED270B)).min() if len(s) else 0 for s in sets], np.uint64)
        fresh.append(np.concatenate(sets))
        held += len(fresh[-1])
        if held > 2_000_000:
            count()
        yield pa.RecordBatch.from_arrays(
            [pa.array((part << 32) + np.arange(seq, seq + n, dtype=np.int64)), batch.column(0), pa.array(np.array([len(s) for s in sets], np.int32)), pa.array(_signed(least)), batch.column(1), pa.nulls(n, pa.binary())],
            ["rid", "doc_id", "n", "gk", "text", "stats"],
        )
        seq += n
    if held:
        count()
    if repeated:
        tokens, at = np.unique(np.concatenate([r[0] for r in repeated]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([r[1] for r in repeated]), minlength=len(tokens)).astype(np.int64)
        top = np.sort(np.argsort(-counts, kind="stable")[:FREQUENT])
        row = [None, None, None, None, None, _pack([tokens[top], counts[top]])]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary()))], ["rid", "doc_id", "n", "gk", "text", "stats"])


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            tokens, counts = _unpack(raw.as_py(), [np.uint64, np.int64])
            yield pa.RecordBatch.from_arrays([pa.array(_signed(tokens)), pa.array(counts)], ["token", "n"])


def _frequent(texts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of at least so many documents, at most FREQUENT of them, sorted, with their places by count."""
    stats = texts.filter("rid IS NULL").select("stats").mapInArrow(_counts, "token long, n long")
    top = stats.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "token").limit(FREQUENT).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(tokens)
    # the more frequent, the later
    return tokens[order], (len(tokens) - 1 - np.arange(len(tokens)))[order].astype(np.int64)


def in_order(tokens: np.ndarray, frequent: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens in the global order, by hash and then the frequent ones, and their places in it as integers."""
    keys = (tokens >> np.uint64(2)).astype(np.int64)
    if not len(frequent):
        return tokens, keys
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    is_frequent = frequent[at] == tokens
    if not is_frequent.any():
        return tokens, keys
    keys[is_frequent] = (1 << 62) + places[at[is_frequent]]
    order = np.argsort(keys, kind="stable")
    return tokens[order], keys[order]


def can_link(shared, nq, last, low, high, last_low, last_high, percent: int):
    """Whether a query can link with a set of a group, from the prefix tokens they share at most.

    Sets of low..high tokens whose last prefix tokens lie at last_low..last_high in the order. What two sets have
    in common lies in both prefixes up to the earlier of their last prefix tokens, or beyond the prefix of the one
    whose last prefix token that is. In the latter case a set of n tokens has ceil(n) beyond, which grows by less
    than the bound where the rounding stands still, so that the best size is the largest or the one before it.
    Works on numbers, arrays and Columns alike; the first gives numpy functions."""
    np_like = not hasattr(nq, "isNull")
    ceil = (lambda x: -(-x * percent // 100)) if np_like else (lambda x: F.ceil(x * percent / 100))
    floor = (lambda x: x * 100 // percent) if np_like else (lambda x: F.floor(x * 100 / percent))
    least, most = (np.minimum, np.maximum) if np_like else (F.least, F.greatest)
    low, high = most(low, ceil(nq)), least(high, floor(nq))
    reach = lambda beyond, other: (shared + beyond - 1) * (100 + percent) >= percent * (nq + other)
    mine = (last <= last_high) & reach(ceil(nq), low)
    under = most(low, high - 1)
    theirs = (last > last_low) & (reach(ceil(high), high) | reach(ceil(under), under))
    return (low <= high) & (mine | theirs)


def _group(frequent: np.ndarray, places: np.ndarray, buckets: int, percent: int, tries: int):
    """Texts sorted by least shingle and size -> members of groups, and the cells of the token-group matrix."""
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    names = [f.split(" ")[0] for f in GROUPED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker()
        ids, last = (TaskContext.get().partitionId() << 32), None
        classes: dict[bytes, tuple[int, int]] = {}  # of the current key: digest -> class, group
        leaders: list[list] = []  # of the current key: [group, set]
        members: list[tuple] = []
        prefixes: list[tuple[int, int, int, np.ndarray]] = []  # class, group, size, prefix tokens
        # a group that has been left may still get no more classes: its key is over
        sizes: dict[int, list[int]] = {}

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names)

        def cells():
            """The matrix cells of the groups gathered so far, by bucket of tokens."""
            if not prefixes:
                return
            n = np.array([len(p[3]) for p in prefixes])
            tokens, at = np.concatenate([p[3] for p in prefixes]), np.repeat(np.arange(len(prefixes)), n)
            meta = np.array([(p[0], p[1], p[2], *sizes[p[1]]) for p in prefixes], np.int64)
            bucket = (tokens >> np.uint64(32)).astype(np.int64) * buckets >> 32
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                mine = order[cuts[b] : cuts[b + 1]]
                if len(mine):
                    used, who = np.unique(at[mine], return_inverse=True)
                    columns = [tokens[mine], who.astype(np.int32), *np.ascontiguousarray(meta[used].T)]
                    yield rows([(1, None, None, None, None, TaskContext.get().partitionId(), None, None, b, _pack(columns))])

        for batch in common.byte_slices(batches, "text", 4_000_000):
            sets = shingle_sets(batch.column(4))
            for rid, doc_id, key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), sets):
                if key != last:
                    if len(prefixes) >= 20_000:
                        yield from cells()
                        prefixes, sizes = [], {}
                    classes, leaders, last = {}, [], key
                if not len(s) or doc_id is None:
                    members.append((0, rid, doc_id, len(s), None, None, False, None, None, None))
                    continue
                digest = xxhash.xxh128_digest(s.tobytes())
                known = classes.get(digest)
                if known is None:
                    cid = ids = ids + 1
                    gid = next((g for g, lead in reversed(leaders[-tries:]) if linked(s, lead, percent)), None)
                    if gid is None:
                        gid = cid
                        leaders.append([gid, s])
                        sizes[gid] = [0, len(s), len(s)]
                    group = sizes[gid]
                    group[0], group[1], group[2] = group[0] + 1, min(group[1], len(s)), max(group[2], len(s))
                    known = classes[digest] = cid, gid
                    ordered, keys = in_order(s, frequent, places)
                    prefix = ordered[: len(s) - need(len(s), percent) + 1].copy()
                    prefixes.append((cid, gid, len(s), prefix))
                    members.append((0, rid, doc_id, len(s), cid, gid, cid == gid, int(keys[len(prefix) - 1]), None, None))
                else:
                    members.append((0, rid, doc_id, len(s), *known, None, None, None, None))
            if len(members) > 20_000:
                yield rows(members)
                members = []
        if members:
            yield rows(members)
        yield from cells()

    return run


class _Runs:
    """The cells of a bucket as runs of one token, those with a single group left out."""

    def __init__(self, cells: list[bytes], columns: int):
        tokens, who, base, meta = [], [], 0, []
        for raw in cells:
            t, w, *values = _unpack(raw, [np.uint64, np.int32, *[np.int64] * columns])
            tokens.append(t)
            who.append(w.astype(np.int64) + base)
            meta.append(values)
            base += len(values[0])
        tokens, who = np.concatenate(tokens), np.concatenate(who)
        #: of each class: itself, its group, its size, and what else the cells hold
        self.meta = [np.concatenate([m[k] for m in meta]) for k in range(columns)]
        self.cid, self.gid, self.n = self.meta[:3]
        order = np.lexsort((self.gid[who], tokens))
        tokens, who = tokens[order], who[order]
        first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        run, group = np.cumsum(first) - 1, self.gid[who]
        new = first | np.concatenate([[True], group[1:] != group[:-1]])
        keep = np.bincount(run, weights=new)[run] > 1
        #: place of the run and class of each cell, and whether it is its group's first in the run
        self.run, self.who, self.new = np.unique(run[keep], return_inverse=True)[1], who[keep], new[keep]


def _by_bucket(work, columns: int):
    """Rows (bucket, cells) sorted by bucket -> what work makes of each bucket's cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker()
        bucket, cells = None, []
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket:
                    if cells:
                        yield from work(_Runs(cells, columns))
                    bucket, cells = b, []
                cells.append(raw)
        if cells:
            yield from work(_Runs(cells, columns))

    return run


def _rename(group: int | None, facts_: int, held: int):
    """Rows (part, facts, bucket, cells) sorted by part, its facts first -> the cells of the classes that have facts.

    facts: rows of `facts_` numbers, a class first, sorted by class. New cells hold (class, group, size) and the other
    facts; `group` is the place of the class's new group among them. Old cells hold `held` numbers for a class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, facts = None, None
        for batch in batches:
            for p, raw, bucket, cells in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                if raw.is_valid:
                    part, facts = p, np.array(raw.values.flatten().to_numpy(zero_copy_only=False)).reshape(-1, facts_).T
                    continue
                if p != part:
                    continue  # none of its classes shares a token
                tokens, who, cid, gid, n, *_ = _unpack(cells.as_py(), [np.uint64, np.int32, *[np.int64] * held])
                at = np.minimum(np.searchsorted(facts[0], cid), facts.shape[1] - 1)
                some = facts[0][at] == cid
                keep = some[who]
                if keep.any():
                    place = np.cumsum(some) - 1
                    new = [f[at[some]] for f in facts]
                    columns = [cid[some], gid[some] if group is None else new[group], n[some], *(f for k, f in enumerate(new) if k not in (0, group))]
                    packed = _pack([tokens[keep], place[who[keep]].astype(np.int32), *columns])
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([bucket], pa.int64()), pa.array([packed], pa.binary())], ["part", "bucket", "cells"])

    return run


def _renamed(cells: DataFrame, facts: DataFrame, names: tuple[str, ...], group: int | None, held: int) -> DataFrame:
    """cells (part, bucket, cells) with the facts (cid, ...) of their classes; classes without facts are left out."""
    by_part = facts.select(F.shiftright("cid", 32).alias("part"), F.array(*(F.col(n).cast("long") for n in names)).alias("f")).groupBy("part").agg(F.array_sort(F.collect_list("f")).alias("facts"))
    rows = by_part.select("part", "facts", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("cells"))
    rows = rows.unionByName(cells.select("part", F.lit(None).cast("array<array<bigint>>").alias("facts"), "bucket", "cells"))
    dealt = rows.repartition("part").sortWithinPartitions("part", F.col("bucket").asc_nulls_first())
    return dealt.mapInArrow(_rename(group, len(names), held), RENAMED)


def _read(cells: DataFrame, work, columns: int, schema: str) -> DataFrame:
    """What work makes of the matrix, bucket by bucket."""
    return cells.select("bucket", "cells").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(work, columns), schema)


def _weights(runs: _Runs) -> Iterator[pa.RecordBatch]:
    """(class, its tokens that other groups have, how many cells those have)."""
    if len(runs.run):
        who, shares = np.unique(runs.who, return_counts=True)
        weight = np.bincount(runs.who, weights=np.bincount(runs.run)[runs.run])[who].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (runs.cid[who], shares.astype(np.int64), weight)], ["cid", "shares", "weight"])


def _stars(runs: _Runs) -> Iterator[pa.RecordBatch]:
    """(query class, the central class of its tokens, tokens, its size): a row for each cell at most.

    Central is the class of a token whose tokens have the most cells: of near copies, the one they were made from."""
    if not len(runs.run):
        return
    weight = runs.meta[3]
    order = np.lexsort((runs.cid[runs.who], weight[runs.who], runs.run))
    last = np.concatenate([np.flatnonzero(np.diff(runs.run[order])), [len(order) - 1]])
    hub = runs.who[order[last]][runs.run]
    other = hub != runs.who
    key, shared = np.unique(runs.who[other] * len(runs.cid) + hub[other], return_counts=True)
    q, s = key // len(runs.cid), key % len(runs.cid)
    if len(q):
        columns = (runs.cid[q], runs.cid[s], shared.astype(np.int32), runs.n[q].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "s", "shared", "nq"])


def _overlaps(percent: int, chunk: int = 2_000_000):
    """(query class, its component, component, prefix tokens of the class in that one's union), where a link can be."""

    def work(runs: _Runs) -> Iterator[pa.RecordBatch]:
        if not len(runs.run):
            return
        cid, gid, n, size, low, high, last, shares, last_low, last_high, most, family = runs.meta
        # a class stands for its component, whose facts its columns hold, and for its family in it
        order = np.lexsort((family[runs.who], gid[runs.who], runs.run))
        keys = np.stack([runs.run[order], gid[runs.who[order]], family[runs.who[order]]])
        new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
        heads, head_run = runs.who[order][new], runs.run[order][new]
        start = np.searchsorted(head_run, runs.run, "left")
        count = np.searchsorted(head_run, runs.run, "right") - start
        who, ends, found, times_found, a = runs.who, np.cumsum(count), [], [], 0
        names, first_of, group_of = np.unique(gid, return_index=True, return_inverse=True)
        while a < len(who):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + chunk, "right")))
            q = np.repeat(who[a:b], count[a:b])
            g = heads[np.repeat(start[a:b], count[a:b]) + np.arange(len(q)) - np.repeat(ends[a:b] - count[a:b] - done, count[a:b])]
            # queries come from the smaller component of a pair; families have been compared
            ok = (gid[q] != gid[g]) & (family[q] != family[g]) & ((size[q] < size[g]) | ((size[q] == size[g]) & (gid[q] < gid[g])))
            q, g = q[ok], g[ok]
            ok = can_link(np.minimum(shares[q], most[g]), n[q], last[q], low[g], high[g], last_low[g], last_high[g], percent)
            key, times = np.unique(q[ok] * len(names) + group_of[g[ok]], return_counts=True)
            found.append(key)
            times_found.append(times)
            a = b
        key, at = np.unique(np.concatenate(found), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate(times_found), minlength=len(key)).astype(np.int32)
        q, g = key // len(names), key % len(names)
        if len(q):
            f = first_of[g]
            columns = (cid[q], gid[q], names[g], times, n[q], last[q], low[f], high[f], last_low[f], last_high[f])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split(" ")[0] for c in MATRIX.split(", ")])

    return work


def _verify(percent: int):
    """(a, b, text_a, text_b) -> the pairs that link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker()
        for batch in common.byte_slices(batches, "text_a", 2_000_000):
            left, right = (batch.column(k).dictionary_encode() for k in (2, 3))
            sets = [shingle_sets(c.dictionary) for c in (left, right)]
            ok = [linked(sets[0][x], sets[1][y], percent) for x, y in zip(left.indices.to_pylist(), right.indices.to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def links(members: list[np.ndarray], queries: list[np.ndarray], percent: int, width: int = 4096) -> np.ndarray:
    """Which queries (rows) link with which members (columns), from exact overlaps of whole sets."""
    def columns(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (mine, m), (asked, q) = columns(members), columns(queries)
    shared = np.intersect1d(mine, asked)
    overlap = np.zeros((len(queries), len(members)), np.float32)
    at = [np.searchsorted(shared, x) for x in (mine, asked)]
    hit = [(a < len(shared)) & (shared[np.minimum(a, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool) for a, x in zip(at, (mine, asked))]
    (mine, m), (asked, q) = ((a[h], o[h]) for a, h, o in zip(at, hit, (m, q)))
    for low in range(0, len(shared), width):
        left, right = np.zeros((len(queries), width), np.float32), np.zeros((len(members), width), np.float32)
        now = (asked >= low) & (asked < low + width)
        left[q[now], asked[now] - low] = 1
        now = (mine >= low) & (mine < low + width)
        right[m[now], mine[now] - low] = 1
        overlap += left @ right.T
    overlap = np.rint(overlap).astype(np.int64)
    union = np.array([len(s) for s in queries])[:, None] + np.array([len(s) for s in members])[None] - overlap
    return (overlap > 0) & (100 * overlap >= percent * union)


def _compare(percent: int, at_once: int = 128):
    """Members of a block and then queries (key, block, slice, kind, gid, text) -> edges between the groups that link.

    Edges that add nothing to those of the block are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker()
        last, members, queries, parent, edges = None, [], [], {}, []

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def ask():
            if members and queries:
                for k, j in zip(*np.nonzero(links([m[1] for m in members], [q[1] for q in queries], percent))):
                    u, v = find(queries[k][0]), find(members[j][0])
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        edges.append((queries[k][0], members[j][0]))
            queries.clear()

        for batch in common.byte_slices(batches, "text", 4_000_000):
            key, block, part, kind, gid = (batch.column(k).to_pylist() for k in range(5))
            for k, s in enumerate(shingle_sets(batch.column(5))):
                if (key[k], block[k], part[k]) != last:
                    ask()
                    last = key[k], block[k], part[k]
                    members.clear()
                    parent.clear()
                if kind[k] == 0:
                    members.append((gid[k], s))
                    continue
                queries.append((gid[k], s))
                if len(queries) >= at_once:
                    ask()
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["u", "v"])
                edges.clear()
        ask()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["u", "v"])

    return run


def _compared(members: DataFrame, queries: DataFrame, texts: DataFrame, percent: int, blocks_: int) -> DataFrame:
    """Edges (u, v) between groups: of members (key, gid, rid) and queries (key, gid, rid) of the same key, compared in
    blocks of members, each with all the key's queries, slice by slice."""
    members, queries = common.materialize(members, "members"), common.materialize(queries, "queries")
    blocks, slices = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int"), F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int")
    asked = queries.groupBy("key").agg(F.count(F.lit(1)).alias("asked"))
    parts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(asked, "key").select("key", "n", "asked", blocks.alias("blocks"), slices.alias("slices"))
    parts, sums = common.measured(parts, "parts", members=F.sum("n"), queries=F.sum("asked"), most=F.max("n"), most_asked=F.max("asked"))
    shown = common.hub_join(members, parts, "key", "n", common.hub_bound(sums["members"] or 0), sums["most"] or 0)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    shown = shown.select("key", some("blocks").alias("block"), each("slices").alias("slice"), F.lit(0).alias("kind"), "gid", "rid")
    asking = common.hub_join(queries, parts, "key", "asked", common.hub_bound(sums["queries"] or 0), sums["most_asked"] or 0)
    asking = asking.select("key", each("blocks").alias("block"), some("slices").alias("slice"), F.lit(1).alias("kind"), "gid", "rid")
    rows, sums = common.measured(shown.unionByName(asking), "opened", n=F.count(F.lit(1)))
    dealt = rows.join(_texts_of(texts, rows, sums["n"], blocks_), "rid").select("key", "block", "slice", "kind", "gid", "text").repartition("key", "block", "slice").sortWithinPartitions("key", "block", "slice", "kind", "gid")
    return common.materialize(dealt.mapInArrow(_compare(percent), EDGES).distinct(), "links")


def _texts_of(texts: DataFrame, wanted: DataFrame, n: int, blocks: int) -> DataFrame:
    """(rid, text) of the rows that a written table of n rows names; `blocks`: how many blocks of 512 ids texts has."""
    rows, ids = texts.select("rid", "text"), wanted.select("rid").distinct()
    if min(n, blocks) > BROADCAST_BLOCKS:
        return rows.join(ids, "rid", "left_semi")
    # the driver holds a bit for an id and not the id: a word of 64 ids, eight of them a row
    word, bit = F.shiftright("rid", 6).bitwiseAND(F.lit(7)), F.expr("shiftleft(1L, CAST(rid & 63 AS INT))")
    words = (F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(8))
    bitmap = F.broadcast(ids.filter("rid IS NOT NULL").groupBy(F.shiftright("rid", 9).alias("block")).agg(*words))
    mine = F.element_at(F.array(*(F.col(f"w{k}") for k in range(8))), word.cast("int") + 1)
    there = (F.shiftright("rid", 9) == F.col("block")) & (F.getbit(mine, F.col("rid").bitwiseAND(F.lit(63)).cast("int")) == 1)
    return rows.join(bitmap, there, "left_semi")


def _linked_pairs(pairs: DataFrame, texts: DataFrame, percent: int, blocks: int) -> DataFrame:
    """Of pairs (a, b, rid_a, rid_b), the (a, b) whose whole sets link."""
    pairs, sums = common.measured(pairs, "pairs", n=F.count(F.lit(1)))
    some = _texts_of(texts, pairs.select(F.explode(F.array("rid_a", "rid_b")).alias("rid")), 2 * sums["n"], blocks)
    left = pairs.join(some.withColumnsRenamed({"rid": "rid_a", "text": "text_a"}), "rid_a")
    both = left.join(some.withColumnsRenamed({"rid": "rid_b", "text": "text_b"}), "rid_b")
    return common.materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, percent: int = 75, bucket_tokens: int = 750_000, frequent_from: int = 12, tries: int = 8) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id. A bucket of the matrix holds about `bucket_tokens` cells."""
    with common.small_broadcasts(docs.sparkSession):
        return _components(docs, percent, bucket_tokens, frequent_from, tries)


def _components(docs: DataFrame, percent: int, bucket_tokens: int, frequent_from: int, tries: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    texts, sums = common.measured(rows.mapInArrow(_sign, TEXTS), "texts", prefixes=F.sum(prefix), rows=F.count("rid"), parts=F.max(F.shiftright("rid", 32)))
    blocks = (sums["rows"] or 0) // 512 + (sums["parts"] or 0) + 1
    frequent, places = _frequent(texts, frequent_from)
    real = texts.filter("rid IS NOT NULL")
    buckets = max(1, -(-int(sums["prefixes"] or 0) // bucket_tokens))
    dealt = real.select("rid", "doc_id", "n", "gk", "text").repartitionByRange("gk", "n", "rid").sortWithinPartitions("gk", "n", "rid")
    grouped = common.materialize(dealt.mapInArrow(_group(frequent, places, buckets, percent, tries), GROUPED), "groups")
    members = grouped.filter("kind = 0").select("rid", "doc_id", "n", "cid", "gid", "leader", "last")
    cells = grouped.filter("kind = 1").select(F.col("gid").alias("part"), "bucket", "cells")
    classes = members.filter("leader IS NOT NULL AND cid IS NOT NULL").select("cid", "gid", "rid", "n", "leader", "last")

    # classes that share no prefix token with another group are done: most cells go here
    shares = _read(cells, _weights, 6, WEIGHTS).groupBy("cid").agg(F.sum("shares").alias("shares"), F.sum("weight").alias("weight"))
    shares = common.materialize(shares, "shares")
    kept = common.materialize(_renamed(cells, shares, ("cid", "weight"), None, 6), "kept")

    # first reading: each class with the central classes of its tokens
    stars = _read(kept, _stars, 4, STARS).groupBy("q", "s").agg(F.sum("shared").alias("shared"), F.max("nq").alias("nq"))
    stars = common.materialize(stars, "stars")

    # classes that share a fifth of their prefix with a central class are of its family
    near = stars.filter(F.col("shared") * 1000 >= F.col("nq") * (100 - percent) * 2)
    kin = components(near.select(F.col("q").alias("u"), F.col("s").alias("v")))
    family = classes.select("cid", "gid", "rid").join(kin.select(F.col("node").alias("cid"), F.col("root").alias("family")), "cid")
    family = common.materialize(family, "families")
    # each with the central class that it meets most
    best = near.groupBy("q").agg(F.max_by("s", F.struct("shared", "s")).alias("s"))
    here, there = (family.select(F.col("cid").alias(c), F.col("gid").alias(g), F.col("rid").alias(r)) for c, g, r in (("q", "a", "rid_a"), ("s", "b", "rid_b")))
    best, sums = common.measured(best.join(here, "q"), "best", n=F.count(F.lit(1)))
    there = common.materialize(there.join(best.groupBy("s").agg(F.count(F.lit(1)).alias("near")), "s"), "central")
    first = common.hub_join(best, there, "s", "near", common.hub_bound(sums["n"])).filter("a <> b").select("a", "b", "rid_a", "rid_b")
    met = _linked_pairs(first, texts, percent, blocks).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    # and those outside the family's largest part with all of it
    parts = family.join(components(met).select(F.col("node").alias("gid"), "root"), "gid", "left").withColumn("part", F.coalesce("root", "gid"))
    parts, sums = common.measured(parts.select(F.col("family").alias("key"), "part", "gid", "rid"), "parts", n=F.count(F.lit(1)))
    largest = parts.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("size"))
    apart = common.hub_join(parts, largest, "key", "size", common.hub_bound(sums["n"])).filter("part <> largest").select("key", "gid", "rid")
    common.collect_garbage(docs.sparkSession)
    edges = common.materialize(met.unionByName(_compared(parts.select("key", "gid", "rid"), apart, texts, percent, blocks)), "edges")
    roots = common.materialize(components(edges), "roots")
    common.collect_garbage(docs.sparkSession)

    # second reading, with the groups of a component as one, and without classes that share no token
    of_group = classes.groupBy("gid").agg(F.count(F.lit(1)).alias("classes")).join(roots.select(F.col("node").alias("gid"), "root"), "gid", "left")
    of_group, sums = common.measured(of_group.select("gid", "classes", F.coalesce("root", "gid").alias("root")), "rooted", classes=F.sum("classes"), most=F.max("classes"))
    bound = common.hub_bound(sums["classes"] or 0)
    rooted = common.materialize(common.hub_join(classes, of_group, "gid", "classes", bound, sums["most"] or 0).drop("classes"), "rooted")
    some = rooted.join(shares.select("cid", "shares"), "cid").join(family.select("cid", "family"), "cid", "left").withColumn("family", F.coalesce("family", "cid"))
    some = common.materialize(some.select("cid", "root", "last", "shares", "family"), "sharing")
    whole = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("n").cast("long").alias("low"), F.max("n").cast("long").alias("high"), F.min("last").alias("last_low"), F.max("last").alias("last_high"))
    whole = common.materialize(whole.join(some.groupBy("root").agg(F.max("shares").alias("most")), "root"), "whole")
    names = ("cid", "root", "size", "low", "high", "last", "shares", "last_low", "last_high", "most", "family")
    facts = common.hub_join(some, whole, "root", "size", bound)
    dealt = _read(_renamed(kept, facts, names, 1, 4), _overlaps(percent), 12, MATRIX)
    shared = dealt.groupBy("q", "gq", "g").agg(F.sum("shared").alias("shared"), *(F.max(c).alias(c) for c in ("nq", "last", "low", "high", "last_low", "last_high")))
    open_ = shared.filter(can_link(*(F.col(c) for c in ("shared", "nq", "last", "low", "high", "last_low", "last_high")), percent))
    asked = open_.join(classes.select(F.col("cid").alias("q"), "gid", "rid"), "q").select(F.col("g").alias("key"), "gid", "rid")
    inside = rooted.select(F.col("root").alias("key"), "gid", "rid")
    edges = edges.unionByName(_compared(inside, asked, texts, percent, blocks))
    # rows that share a doc_id are one node
    grouped_rows = members.filter("gid IS NOT NULL").select("doc_id", "gid", F.col("n").cast("long").alias("n_shingles"))
    named, sums = common.measured(grouped_rows.groupBy("gid").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("rows")), "named", rows=F.sum("rows"), most=F.max("rows"))
    most = sums["most"] or 0
    bound = common.hub_bound(sums["rows"] or 0)
    pairs = grouped_rows.groupBy("doc_id", "gid").agg(F.count(F.lit(1)).alias("rows"))
    several = common.materialize(pairs.groupBy("doc_id").agg(F.min("gid").alias("u"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "several")
    edges = edges.unionByName(common.hub_join(pairs, several, "doc_id", "size", bound).select("u", F.col("gid").alias("v")))
    # groups go by the least doc_id of their rows: the root of a component is then its least document, and no
    # component meets in one task to find it
    ends, sums = common.measured(edges.select("u", "v"), "ends", n=F.count(F.lit(1)))
    degree = ends.select(F.explode(F.array("u", "v")).alias("gid")).groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    least, many = common.materialize(named.select("gid", "d").join(degree, "gid"), "ends"), common.hub_bound(2 * sums["n"])
    for end in ("u", "v"):
        ends = common.hub_join(ends, least.withColumnsRenamed({"gid": end, "d": f"d_{end}"}), end, "size", many).drop("size")
    roots = common.materialize(components(ends.select(F.col("d_u").alias("u"), F.col("d_v").alias("v"))), "roots")
    of_group = named.join(roots.select(F.col("node").alias("d"), "root"), "d", "left").select("gid", "rows", F.coalesce("root", "d").alias("component_id"))
    # runs when the caller's job does, with the caller's settings
    found = common.hub_join(grouped_rows, common.materialize(of_group, "named").hint("merge"), "gid", "rows", bound, most)
    alone = members.filter("gid IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, that of least doc_id; all columns as they were."""
    rows = common.plain_names(docs)
    found = jaccard_components(rows)
    dropped = found.filter("component_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    return rows.join(dropped, "doc_id", "left_anti").select(*rows.columns).toDF(*docs.columns)
