"""Language-model scoring with a weighted backoff automaton (operator 10).

The model is a trigram model with Dirichlet smoothing over the add-one unigram model:

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | v)   = (c(v w) + MU[0] p(w)) / (c(v) + MU[0])
    p(w | u v) = (c(u v w) + MU[1] p(w | v)) / (c(u v) + MU[1])

As an automaton, a state stands for the last tokens that were seen together in training: two, one or (the root)
none. A seen continuation is an arc with its log10 probability to the state of the longest seen suffix; a failure
arc carries log10 MU / (c + MU) to the state without the oldest token; the root has an arc for every token. A text
is scored in one traversal from left to right that carries the state and takes failure arcs until there is an arc.

The whole model is never in one place. Documents are written as blocks of some MB. Each block asks for the counts
of its own distinct tokens and bigrams, dealt by key: a key leaves a block once, however frequent it is, and the
answers come back in the order of the block's sorted keys, with a mark at what other blocks ask for too. A trigram
can be elsewhere only if both its bigrams are, so a second exchange asks for those trigrams alone; of all others the
block's own count is the whole count. A block then builds the part of the automaton that its documents can reach,
with counts over all training documents.

Tokens and n-grams are told apart by 64-bit hashes: among n of them a given one meets another with odds n / 2**64,
below one in a million for the n-grams of 100 TB. Rows of the exchange are a block's keys in a range of keys; more
than `buckets` ranges are made where a range would hold over `bucket_bytes`, so blocks should grow with the input
beyond a TB (`block_bytes`), which keeps those rows at a KB or more.

Defined results: null text counts as empty (its end token alone); a null doc_id is no held-out row unless
crc32 of the empty text says so; rows that share a doc_id are scored each on its own; without training tokens
every probability is 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.words import hash_words

#: The end and the start of a document; words hold no white space, so none has these hashes by its text.
END, START = (np.uint64(xxhash.xxh64_intdigest(b"\n" + name)) for name in (b"end", b"start"))
MU = (1000.0, 20.0)  # tokens of prior weight for contexts of one and of two tokens

BLOCK = "block long, docs binary"
ASK = "bucket long, kind int, block long, keys binary, counts binary"
ANSWER = "block long, kind int, bucket long, counts binary, tokens long, types long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of the values, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unpack(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(dtype)


def _blocks(limit: int):
    """Rows (doc_id, held_out, text) -> blocks of them, as compressed Arrow streams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, size
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            raw = zstandard.ZstdCompressor(level=1).compress(sink.getvalue())
            row = pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([raw], pa.binary())], ["block", "docs"])
            seq, held, size = seq + 1, [], 0
            return row

        for batch in common.byte_slices(batches, "text", limit // 4):
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= limit:
                yield flush()
        if held:
            yield flush()

    return run


class Block:
    """The token sequence of a block's documents: hashes of its tokens, bigrams and trigrams, and where documents end."""

    def __init__(self, raw: bytes):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_all().combine_chunks()
        self.doc_ids, self.held_out = table.column(0).combine_chunks(), table.column(1).to_numpy(zero_copy_only=False).astype(bool)
        hashes, counts = hash_words(table.column(2).combine_chunks())
        self.n_tokens = counts + 1
        self.ends = np.cumsum(self.n_tokens)  # one past each document's end token
        self.first = self.ends - self.n_tokens
        self.tokens = np.full(int(self.ends[-1]), END, np.uint64)
        inner = np.ones(len(self.tokens), bool)
        inner[self.ends - 1] = False
        self.tokens[inner] = hashes
        before = np.concatenate([[START], self.tokens[:-1]])
        before[self.first] = START
        self.train = np.repeat(~self.held_out, self.n_tokens)
        self.pairs = _joined(before, self.tokens)

    def count(self, at: np.ndarray, n: int, of: np.ndarray | None = None) -> np.ndarray:
        """Training occurrences of n keys, from the places of the positions `of` (all of them if None)."""
        return np.bincount(at[self.train if of is None else self.train[of]], minlength=n)

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct tokens with the start, their places for each position)."""
        keys, at = np.unique(np.concatenate([[START], self.tokens]), return_inverse=True)
        return keys, at[1:]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.pairs, return_inverse=True)

    def trigrams(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct trigrams, which of them others may have, their places, the positions they end at).

        shared: for each position whether others ask for the bigram that ends there. A document's first token ends no trigram."""
        inner = np.ones(len(self.tokens), bool)
        inner[self.first] = False
        of = np.flatnonzero(inner)
        keys, first, at = np.unique(_joined(self.pairs[of - 1], self.tokens[of]), return_index=True, return_inverse=True)
        return keys, (shared[of - 1] & shared[of])[first], at, of


def _joined(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of contexts followed by tokens."""
    with np.errstate(over="ignore"):
        x = (context ^ (context >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + token
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _questions(block_id: int, kind: int, keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a block's sorted keys with their training counts, by range of keys."""
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    rows = [(int(b), kind, block_id, _pack(keys[cuts[b] : cuts[b + 1]]), _pack(counts[cuts[b] : cuts[b + 1]].astype(np.uint32))) for b in np.flatnonzero(np.diff(cuts))]
    for a in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 512]), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "kind", "block", "keys", "counts"])


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def _ask(buckets: int):
    """Blocks -> their distinct tokens and bigrams with training counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for batch in batches:
            for block_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(raw.as_py())
                for kind, find in enumerate((block.unigrams, block.bigrams), 1):
                    keys, at = find()
                    counts = block.count(at, len(keys))
                    if kind == 1:  # the start precedes each document once, as the end closes it
                        counts[np.searchsorted(keys, START)] = 0
                    yield from _questions(block_id, kind, keys, counts, edges)
                    del keys, at

    return run


def _ask_more(buckets: int):
    """A block and then its answers on bigrams -> its distinct trigrams that other blocks may have, with training counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for block_id, raw, answers in _with_answers(batches):
            block = Block(raw)
            _, arc = block.bigrams()
            keys, asked, at, of = block.trigrams((_gathered(answers, 2) & 1).astype(bool)[arc])
            yield from _questions(block_id, 3, keys[asked], block.count(at, len(keys), of)[asked], edges)

    return run


def _answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions sorted by bucket and kind -> for each block the counts over all blocks, in the order of its keys.

    A count is doubled, with 1 added if another block asks for the key too."""
    run, group = None, []

    def close():
        keys = [_unpack(g[1], np.uint64) for g in group]
        counts = np.concatenate([_unpack(g[2], np.uint32) for g in group])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)
        answer = total * 2 + (np.bincount(at, minlength=len(found)) > 1)
        ends = np.cumsum([len(k) for k in keys])
        rows = []
        for k, g in enumerate(group):
            # what the bucket holds counts once, with its first answer
            sums = (int(total.sum()), int((total > 0).sum())) if not k else (0, 0)
            rows.append((g[0], run[1], run[0], _pack(answer[at[ends[k] - len(keys[k]) : ends[k]]]), *sums))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["block", "kind", "bucket", "counts", "tokens", "types"])

    for batch in batches:
        for bucket, kind, block, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if run != (bucket, kind):
                if group:
                    yield close()
                run, group = (bucket, kind), []
            group.append((block, keys, counts))
    if group:
        yield close()


class Automaton:
    """The part of the backoff automaton that a block's documents reach.

    counts: of tokens (as contexts `contexts`), bigrams and trigrams. pairs: (context, token) of each bigram as token
    numbers; triples: (context, last two) of each trigram as bigram numbers. State 0 is the root, 1 + t stands for
    token t, 1 + T + b for bigram b; those of bigrams that end a document are final. Arcs of states of each length are numbered as tokens, bigrams and trigrams are."""

    def __init__(self, counts: list[np.ndarray], contexts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray], tokens: int, types: int, mu: tuple[float, float] = MU):
        c1, c2, c3 = counts
        n = len(c1)
        p1 = (c1 + 1) / (tokens + types + 1)
        p2 = (c2 + mu[0] * p1[pairs[1]]) / (contexts[pairs[0]] + mu[0])
        p3 = (c3 + mu[1] * p2[triples[1]]) / (c2[triples[0]] + mu[1])
        self.weight = [np.log10(p) for p in (p1, p2, p3)]
        self.there = [np.ones(n, bool), c2 > 0, c3 > 0]
        single, double = np.where(contexts > 0, 1 + np.arange(n), 0), 1 + n + np.arange(len(c2))
        self.to = [single, double, double[triples[1]]]
        self.depth = np.concatenate([[0], np.ones(n, np.int8), np.full(len(c2), 2, np.int8)])
        self.fail = np.concatenate([[0], np.zeros(n, np.int64), single[pairs[1]]])
        self.fail_weight = np.concatenate([[0.0], np.log10(mu[0] / (contexts + mu[0])), np.log10(mu[1] / (c2 + mu[1]))])

    def step(self, state: np.ndarray, arcs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """One token further for many texts: the states reached and the log10 weights of the way.

        arcs: for each length of context the arc that the text's token would be; there is none from a longer state
        than the one carried."""
        weight, reached = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        for length in (2, 1, 0):
            mine = self.depth[state[left]] == length
            at = left[mine]
            arc = arcs[length][at]
            there = self.there[length][arc]
            hit, miss = at[there], at[~there]
            weight[hit] += self.weight[length][arc[there]]
            reached[hit] = self.to[length][arc[there]]
            weight[miss] += self.fail_weight[state[miss]]
            state[miss] = self.fail[state[miss]]
            left = np.concatenate([left[~mine], miss]) if length else left[:0]
        return reached, weight

    def traverse(self, arcs: list[np.ndarray], first: np.ndarray, ends: np.ndarray, start: int, length: int = 256) -> np.ndarray:
        """log10 weights at each position of the texts first..ends, all traversed from left to right at once.

        Long texts are cut into parts of `length` tokens. A state is told by the last two tokens, so a part that
        begins inside a text finds its own by reading those two from the root."""
        parts = -(-(ends - first) // length)
        place = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + place * length
        size = np.minimum(length, np.repeat(ends, parts) - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, inside = begin[order], size[order], place[order] > 0
        state = np.where(inside, 0, start)
        for back in (2, 1):
            at = begin[inside] - back
            state[inside], _ = self.step(state[inside], [a[at] for a in arcs])
        out = np.zeros(len(arcs[0]))
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, "left"))
            at = begin[:n] + k
            state[:n], out[at] = self.step(state[:n], [a[at] for a in arcs])
        return out


def _with_answers(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[tuple[int, bytes]]]]:
    """Rows (block, kind, data) sorted by block and kind, the block itself (kind 0) first -> (block, its documents, answers)."""
    last, raw, answers = None, None, []
    for batch in batches:
        for block, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if block != last:
                if raw is not None:
                    yield last, raw, answers
                last, raw, answers = block, data.as_py(), []
            else:
                answers.append((kind, data.as_py()))
    if raw is not None:
        yield last, raw, answers


def _gathered(answers: list[tuple[int, bytes]], kind: int) -> np.ndarray:
    """A block's answers of a kind, in the order of its keys."""
    return np.concatenate([np.zeros(0, np.int64), *(_unpack(a, np.int64) for k, a in answers if k == kind)])


def _score(tokens: int, types: int, mu: tuple[float, float]):
    """Blocks with their answers -> scored documents."""

    def scored(raw: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        block = Block(raw)
        keys, at = block.unigrams()
        pair_keys, arc = block.bigrams()
        c1, asked2 = _gathered(answers, 1) >> 1, _gathered(answers, 2)
        triple_keys, asked, place, of = block.trigrams((asked2 & 1).astype(bool)[arc])
        c2, c3 = asked2 >> 1, block.count(place, len(triple_keys), of)
        c3[asked] = _gathered(answers, 3) >> 1
        start = int(np.searchsorted(keys, START))
        contexts = c1.copy()
        contexts[start], contexts[np.searchsorted(keys, END)] = c1[np.searchsorted(keys, END)], 0  # as many starts as ends
        before = np.concatenate([[start], at[:-1]])
        before[block.first] = start
        pairs = np.zeros((2, len(pair_keys)), np.int64)
        pairs[:, arc] = before, at
        triples = np.zeros((2, max(1, len(triple_keys))), np.int64)
        triples[:, place] = arc[of - 1], arc[of]
        automaton = Automaton([c1, c2, c3 if len(c3) else np.zeros(1, np.int64)], contexts, pairs, triples, tokens, types, mu)
        third = np.zeros(len(at), np.int64)
        third[of] = place
        log_p = automaton.traverse([at, arc, third], block.first, block.ends, 1 + start if contexts[start] else 0)
        known = (c1[at] > 0).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                block.doc_ids,
                pa.array(block.held_out),
                pa.array(block.n_tokens.astype(np.int64)),
                pa.array(np.add.reduceat(known, block.first)),
                pa.array(np.full(len(block.first), tokens, np.int64)),
                pa.array(np.add.reduceat(automaton.weight[0][at], block.first)),
                pa.array(np.add.reduceat(log_p, block.first)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, answers in _with_answers(batches):
            yield scored(raw, answers)

    return run


def _answered(questions: DataFrame) -> DataFrame:
    dealt = questions.repartition("bucket").sortWithinPartitions("bucket", "kind", "block")
    return common.materialize(dealt.mapInArrow(_answer, ANSWER), "answers")


def _by_block(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block and then its answers, in one partition."""
    parts = blocks.select("block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("bucket"), F.col("docs").alias("data"))
    parts = parts.unionByName(answers.select("block", "kind", "bucket", F.col("counts").alias("data")))
    return parts.repartition("block").sortWithinPartitions("block", "kind", "bucket").select("block", "kind", "data")


def lm_scores(docs: DataFrame, held_out, mu: tuple[float, float] = MU, block_bytes: int = 8_000_000, buckets: int = 1024, bucket_bytes: int = 64_000_000) -> DataFrame:
    """Score docs (doc_id, text) with a model of those where the Column held_out is false."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = common.materialize(rows.mapInArrow(_blocks(block_bytes), BLOCK), "blocks")
    # a block's keys take about as many bytes as its text
    buckets = max(buckets, -(-blocks.count() * block_bytes // bucket_bytes))
    answers = _answered(blocks.mapInArrow(_ask(buckets), ASK))
    sums = answers.filter("kind = 1").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = int(sums["tokens"] or 0), int(sums["types"] or 0)
    more = _answered(_by_block(blocks, answers.filter("kind = 2")).mapInArrow(_ask_more(buckets), ASK))
    return _by_block(blocks, answers.unionByName(more)).mapInArrow(_score(tokens, types, mu), SCORED)


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.table(spark, sf_dir, "documents"), common.crc_mod("doc_id", 7) == 2)
