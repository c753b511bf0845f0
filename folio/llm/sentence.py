"""SentencePiece encoding and decoding with a max-plus scan over chunks of giant documents (operator 9).

The public model is of the BPE kind. A sequence of pieces is the model's encoding of a text exactly if each pair
of neighbours is the encoding of its own text, so encoding is a best-path problem whose arcs weigh 0 (the pair
holds) or minus infinity. Over these weights a chunk's transfer matrix, from the pieces that may cross its start
to those that may cross its end, is a table of bits. Matrices of neighbouring chunks combine associatively: level by
level, FAN neighbours become one, many groups at a time, until a document is one matrix. Its last piece is known,
and level by level back down each group finds the pieces that really cross its inner boundaries. Every chunk is then
traced back on its own from the lattice that its scan has stored. No task holds more of a document than FAN
matrices or one chunk until the ids are joined to the document's row.

Documents of up to `giant` characters are encoded by the library, each distinct piece between single blanks
once; longer ones are cut into chunks that different tasks scan and trace. Both give the library's ids.

Defined results: null text counts as empty and has no ids; U+2581, which stands for a blank in the pieces, is
decoded as a blank; rows that share a doc_id are encoded each on its own; an empty table gives no rows; extra
columns are ignored. Null ids are kept. A model of another kind (see `scannable`) encodes whole documents of any length.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common, tokens
from folio.llm.tokens import PieceEncoder, encoder

BLANK = "▁"
ENCODED = "doc_id long, text_sha256 string, ids binary"
CHUNK = "key long, doc_id long, text_sha256 string, chunk int, first int, last int, size int, at int, text string"
SCANNED = "key long, doc_id long, text_sha256 string, chunk int, first int, size int, at int, text string, matrix string, trail binary"
MATRIX = "key long, chunk int, size int, matrix string"
CROSSED = "key long, chunk int, in_start int, in_end int, out_start int, out_end int"
TRACED = "key long, doc_id long, text_sha256 string, chunk int, ids binary"
#: Neighbouring matrices that are combined at once.
FAN = 16
#: Chunks of a task.
CHUNKS = 4

#: (start, end) of a piece in the document's marked text; START is the state before the first piece.
State = tuple[int, int]
START: State = (-1, 0)


def read_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def scannable(model) -> bool:
    """Whether the model is of the kind that pieces and the scan rely on: BPE over bytes, blanks kept and marked, a
    blank before the text, characters unchanged, and no symbols that a user defined."""
    norm, trained = model.normalizer_spec, model.trainer_spec
    kept = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    return kept and trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix and all(p.type in (1, 2, 3, 6) for p in model.pieces)


class SentenceEncoder(PieceEncoder):
    """The piece table over a SentencePiece model: pieces between single blanks are independent of one another."""

    def _load(self, path: str) -> None:
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cuts = scannable(read_model(path))

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        odd = pc.match_substring_regex(texts, r"\A | \z|  |" + BLANK).to_numpy(zero_copy_only=False) | (not self.cuts)
        return odd, pc.split_pattern(texts.filter(pa.array(~odd)), " ")

    def _codes(self, pieces: list[str]) -> list[list[int]]:
        return self.tokenizer.encode(pieces, num_threads=1)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text)


class Lattice:
    """Pieces of a model and which of them may follow one another."""

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece

        model = read_model(path)
        model.normalizer_spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        self.longest, self.most, self._pairs = max(map(len, self.ids)), most, {}

    def holds(self, a: str, b: str) -> bool:
        """Whether a and b (a may be empty) are the pieces of their own text; characters without a piece are one."""
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) > self.most:
                self._pairs.clear()
            got = self._pairs[a, b] = self.plain.encode(a + b) == (self.code(a) if a else []) + self.code(b)
        return got

    def pieces_at(self, text: str, at: int, end: int) -> Iterator[str]:
        """The pieces that begin at a place of the text, one character at least."""
        for n in range(1, min(self.longest, end - at) + 1):
            piece = text[at : at + n]
            if n == 1 or piece in self.ids:
                yield piece

    def code(self, piece: str) -> list[int]:
        got = self.ids.get(piece)
        return [self.bytes[b] for b in piece.encode()] if got is None else [got]


def mark(text: str) -> str:
    """A text as the model reads it."""
    return BLANK + text.replace(" ", BLANK) if text else ""


class Chunk:
    """Places first..last of a marked text of `size` characters; `text` is the part from place `at` with the context needed."""

    def __init__(self, lattice: Lattice, text: str, at: int, first: int, last: int, size: int):
        self.lattice, self.text, self.at, self.first, self.last = lattice, text, at, first, last
        if first == 0:
            self.entries = [START]
        else:
            reach = range(max(0, first - lattice.longest), first)
            self.entries = [(i, i + len(p)) for i in reach for p in lattice.pieces_at(text, i - at, min(size, i + lattice.longest) - at) if i + len(p) >= first and lattice.holds("", p)]
        self.nodes: dict[int, list[tuple[int, int]]] = {}  # end -> (start, bits of the entries that lead there)
        for k, (start, end) in enumerate(self.entries):
            self.nodes.setdefault(end, []).append((start, 1 << k))
        self.own: dict[int, list[tuple[int, int]]] = {}
        for i in range(first, last):
            before = self.nodes.get(i)
            if not before:
                continue
            held = [(self._piece(start, i), bits) for start, bits in before]
            for piece in lattice.pieces_at(text, i - at, size - at):
                bits = 0
                for a, b in held:
                    if lattice.holds(a, piece):
                        bits |= b
                if bits:
                    self.nodes.setdefault(i + len(piece), []).append((i, bits))
        self.matrix = [((start, end), bits) for end, found in self.nodes.items() if end >= last for start, bits in found if start < last or end == 0]

    def _piece(self, start: int, end: int) -> str:
        return self.text[start - self.at : end - self.at] if start >= 0 else ""

    def trail(self) -> bytes:
        """What trace() needs of the lattice: the nodes, and the bits of the entries that lead there."""
        masks: dict[int, int] = {}
        rows = [(end, start, masks.setdefault(bits, len(masks))) for end, found in self.nodes.items() for start, bits in found]
        head = json.dumps([self.entries, [hex(m) for m in masks], len(rows)]).encode()
        return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + np.array(rows, "<i4").reshape(-1, 3).T.tobytes())

    @classmethod
    def opened(cls, lattice: Lattice, text: str, at: int, first: int, trail: bytes) -> Chunk:
        """A chunk that can be traced, from its trail."""
        chunk = cls.__new__(cls)
        chunk.lattice, chunk.text, chunk.at, chunk.first = lattice, text, at, first
        raw = zstandard.ZstdDecompressor().decompress(trail)
        size = int.from_bytes(raw[:4], "little")
        entries, masks, n = json.loads(raw[4 : 4 + size])
        chunk.entries, bits, chunk.nodes = [tuple(e) for e in entries], [int(m, 16) for m in masks], {}
        for end, start, mask in np.frombuffer(raw, "<i4", 3 * n, 4 + size).reshape(3, n).T.tolist():
            chunk.nodes.setdefault(end, []).append((start, bits[mask]))
        return chunk

    def trace(self, entry: State, exit_: State) -> list[int]:
        """The ids of the pieces that begin in the chunk on the path from the entry to the exit."""
        bit, path, (start, end) = 1 << self.entries.index(entry), [], exit_
        while start >= self.first and (start, end) != entry:
            piece = self._piece(start, end)
            path.append(piece)
            start, end = next((s, start) for s, bits in self.nodes[start] if bits & bit and self.lattice.holds(self._piece(s, start), piece))
        return [i for piece in reversed(path) for i in self.lattice.code(piece)]


Matrix = tuple[list[State], list[tuple[State, int]]]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The transfer matrix of two neighbouring chunks; associative."""
    place = {state: bits for state, bits in a[1]}
    lead = [place.get(state, 0) for state in b[0]]
    out = []
    for state, bits in b[1]:
        got = 0
        for k, through in enumerate(lead):
            if bits >> k & 1:
                got |= through
        if got:
            out.append((state, got))
    return a[0], out


def last_state(matrix: Matrix, size: int) -> State:
    """The last piece of a text of `size` characters, from the matrix of all of it."""
    return next(state for state, bits in matrix[1] if state[1] == size and bits)


def crossings(matrices: list[Matrix], entry: State, exit_: State) -> list[State]:
    """The states at the boundaries of neighbouring matrices, from the first one's entry to the last one's exit."""
    reached = [{entry}]
    for entries, exits in matrices:
        mask = sum(1 << k for k, state in enumerate(entries) if state in reached[-1])
        reached.append({state for state, bits in exits if bits & mask})
    states = [exit_]
    for k in range(len(matrices) - 1, -1, -1):
        bits = dict(matrices[k][1])[states[-1]]
        states.append(next(s for j, s in enumerate(matrices[k][0]) if bits >> j & 1 and s in reached[k]))
    return states[::-1]


_lattices: dict[str, Lattice] = {}
common.worker_caches.append(_lattices)


def _lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def _encode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker(tokens._encoders)
        for batch in common.byte_slices(batches, "text", 4_000_000):
            ids, at = encoder(path, False, SentenceEncoder).encode(batch.column(2))
            packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((np.asarray(at, np.int64) * 4).tobytes()), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed.cast(pa.binary())], ["doc_id", "text_sha256", "ids"])

    return run


def _cut(path: str, chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, longest = TaskContext.get().partitionId() << 32, _lattice(path).longest
        for batch in common.byte_slices(batches, "text", 1_000_000):
            for doc_id, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                text, key = mark(text), key + 1
                rows = []
                for k, first in enumerate(range(0, len(text), chunk)):
                    last, at = min(first + chunk, len(text)), max(0, first - longest)
                    rows.append({"key": key, "doc_id": doc_id, "text_sha256": digest, "chunk": k, "first": first, "last": last, "size": len(text), "at": at, "text": text[at : last + longest]})
                schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("chunk", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("size", pa.int32()), ("at", pa.int32()), ("text", pa.string())])
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _packed(matrix: Matrix) -> str:
    return json.dumps([matrix[0], [(s, hex(b)) for s, b in matrix[1]]])


def _unpacked(raw: str) -> Matrix:
    entries, exits = json.loads(raw)
    return [tuple(e) for e in entries], [(tuple(s), int(b, 16)) for s, b in exits]


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _scan(path: str):
    """Chunks -> their transfer matrices and what tracing them takes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker(_lattices)
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk(_lattice(path), r["text"], r["at"], r["first"], r["last"], r["size"])
                yield _rows(SCANNED, [(r["key"], r["doc_id"], r["text_sha256"], r["chunk"], r["first"], r["size"], r["at"], r["text"], _packed((chunk.entries, chunk.matrix)), chunk.trail())])

    return run


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by key and chunk -> the rows of each group of neighbours (key, chunk // FAN)."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["key"], row["chunk"] // FAN) != last and held:
                yield held
                held = []
            last = row["key"], row["chunk"] // FAN
            held.append(row)
    if held:
        yield held


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices -> one for each group of neighbours."""
    for group in _groups(batches):
        yield _rows(MATRIX, [(group[0]["key"], group[0]["chunk"] // FAN, group[0]["size"], _packed(reduce(combine, (_unpacked(r["matrix"]) for r in group))))])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of whole documents -> their first and last states."""
    for batch in batches:
        for r in batch.to_pylist():
            yield _rows(CROSSED, [(r["key"], r["chunk"], *START, *last_state(_unpacked(r["matrix"]), r["size"]))])


def _cross(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices with the states at the ends of their group -> the states at the ends of each."""
    for group in _groups(batches):
        r = group[0]
        s = crossings([_unpacked(g["matrix"]) for g in group], (r["in_start"], r["in_end"]), (r["out_start"], r["out_end"]))
        yield _rows(CROSSED, [(r["key"], g["chunk"], *a, *b) for g, a, b in zip(group, s, s[1:])])


def _trace(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker(_lattices)
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk.opened(_lattice(path), r["text"], r["at"], r["first"], r["trail"])
                ids = np.asarray(chunk.trace((r["in_start"], r["in_end"]), (r["out_start"], r["out_end"])), "<u4").tobytes()
                yield _rows(TRACED, [(r["key"], r["doc_id"], r["text_sha256"], r["chunk"], ids)])

    return run


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids by document and chunk -> whole documents."""
    last, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if last and r["key"] != last["key"]:
                yield _rows(ENCODED, [(last["doc_id"], last["text_sha256"], b"".join(held))])
                held = []
            last = r
            held.append(r["ids"])
    if last:
        yield _rows(ENCODED, [(last["doc_id"], last["text_sha256"], b"".join(held))])


def _scanned_ids(chunks: DataFrame, model: str) -> DataFrame:
    """Documents with their ids from a written table of their chunks."""
    shape = chunks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("docs"), F.max("chunk").alias("last")).first()
    if not shape["n"]:
        return chunks.sparkSession.createDataFrame([], ENCODED)
    tasks = math.ceil(shape["n"] / CHUNKS)
    # dealt by number, as adaptive execution would put so few bytes into one task
    scanned = common.materialize(chunks.repartition(tasks, "key", "chunk").mapInArrow(_scan(model), SCANNED), "scanned")
    levels, last, n = [scanned.select("key", "chunk", "size", "matrix")], shape["last"], tasks

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.withColumn("group", F.expr(f"chunk div {FAN}")).repartition(n, "key", "group").sortWithinPartitions("key", "chunk").drop("group")

    while last:
        n, last = math.ceil(n / FAN), last // FAN
        levels.append(common.materialize(grouped(levels[-1]).mapInArrow(_combine, MATRIX), "combined"))
    states = levels.pop().mapInArrow(_ends, CROSSED)
    while levels:
        groups = states.withColumnRenamed("chunk", "group")
        n = min(tasks, n * FAN)
        inner = levels.pop().withColumn("group", F.expr(f"chunk div {FAN}")).join(groups, ["key", "group"]).drop("group")
        states = common.materialize(grouped(inner).mapInArrow(_cross, CROSSED), "crossed")
    traced = scanned.join(states, ["key", "chunk"]).repartition(tasks, "key", "chunk").mapInArrow(_trace(model), TRACED)
    return traced.repartition(shape["docs"], "key").sortWithinPartitions("key", "chunk").mapInArrow(_join, ENCODED)


def encode(docs: DataFrame, model: str, giant: int = 1 << 16, chunk: int = 1 << 14) -> DataFrame:
    """Each row of docs (doc_id, text) with its ids as little-endian uint32, and the sha256 of its text with U+2581 as blanks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.replace(text, F.lit(BLANK), F.lit(" ")), 256).alias("text_sha256"), text.alias("text"))
    if not scannable(read_model(model)):
        return rows.mapInArrow(_encode(model), ENCODED)
    short = rows.filter(F.length("text") <= giant).mapInArrow(_encode(model), ENCODED)
    chunks = common.materialize(rows.filter(F.length("text") > giant).mapInArrow(_cut(model, chunk), CHUNK), "chunks")
    return short.unionByName(_scanned_ids(chunks, model))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Rows with ids -> the same rows with their decoded text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(model, False, SentenceEncoder).tokenizer
        for batch in common.byte_slices(batches, "ids", 4_000_000):
            texts = [tokenizer.decode(np.frombuffer(raw.as_buffer(), "<u4").tolist()) if raw.is_valid and len(raw.as_buffer()) else "" for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, f"{ENCODED}, text string")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    model = model or public_tokenizers.path("piece_bpe_32k.model")
    back = decode(encode(common.table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))
