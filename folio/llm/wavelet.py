"""Token-ID output: one wavelet matrix per shard (operator 5).

`write_shards` encodes every whole text, appends an end id, cuts the token sequence (documents in ascending
doc_id order) into shards of whole documents and stores one compressed file image per shard. `WaveletMatrix`
opens such an image and answers access, rank, select and count; bit-planes are compressed in frames of FRAME bytes
behind a table of their places, so that a look-up opens a frame or two of each plane. `read_shards` reads all shards
back.

Defined results: null text counts as empty (the document is its end id alone); rows with a null doc_id come
first; rows that share a doc_id are ordered by a hash of their text and each keeps its own entry; an empty
table gives no shards; extra columns are ignored. A document longer than a shard gets a shard of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.tokens import encoder

MAGIC = b"FWM2"
RANK_BITS = 512  # a rank sample for each so many bits of a plane
FRAME = 1 << 14  # bytes of a plane that are compressed together, a multiple of those between rank samples
#: Writing tasks up to whose number their rows are broadcast, 12 bytes each; beyond, a shuffle join.
BROADCAST_ROWS = 400_000

SHARD_SCHEMA = "part int, shard int, before long, n_docs long, n_tokens long, image binary"
READ_SCHEMA = "doc_id long, start long, ids binary"


class WaveletMatrix:
    """Succinct sequence of symbols: bit-planes from the highest bit, each stably partitioned by the one above."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.levels, self.n, self.n_docs = struct.unpack_from("<BQQ", image, 4)
        at, blobs = 21, []
        for _ in range(3 + 2 * self.levels):
            (size,) = struct.unpack_from("<Q", image, at)
            blobs.append(image[at + 8 : at + 8 + size])
            at += 8 + size
        self._blobs = blobs
        self._open: dict = {}
        self.zeros = np.frombuffer(self._raw(2), np.int64)

    def _raw(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._blobs[k])

    def _frames(self, level: int) -> tuple[np.ndarray, bytes]:
        """Where a plane's frames end, and the frames."""
        blob = self._blobs[3 + 2 * level]
        (n,) = struct.unpack_from("<I", blob)
        return np.frombuffer(blob, "<u4", n, 4), blob[4 + 4 * n :]

    def _piece(self, level: int, at: int, end: int) -> np.ndarray:
        """Bytes of a plane that lie in one frame, decompressed on first use."""
        k = at // FRAME
        if (level, k) not in self._open:
            ends, frames = self._frames(level)
            self._open[level, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(frames[int(ends[k - 1]) if k else 0 : int(ends[k])]), np.uint8)
        return self._open[level, k][at - k * FRAME : end - k * FRAME]

    def _plane(self, level: int) -> np.ndarray:
        """All bytes of a plane."""
        ends, frames = self._frames(level)
        unpack = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(b"".join(unpack(frames[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())), np.uint8)

    def _samples(self, level: int) -> np.ndarray:
        if level not in self._open:
            self._open[level] = np.frombuffer(self._raw(4 + 2 * level), np.uint32)
        return self._open[level]

    @property
    def doc_ids(self) -> list[int | None]:
        ids, null = np.frombuffer(self._raw(0), np.uint8), self.n_docs
        values = np.frombuffer(ids[null:].tobytes(), np.int64)
        return [None if ids[k] else int(v) for k, v in enumerate(values)]

    @property
    def doc_lengths(self) -> np.ndarray:
        return np.frombuffer(self._raw(1), np.int64)

    @classmethod
    def image(cls, symbols: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
        """The file image of a shard."""
        n = len(symbols)
        levels = max(1, int(symbols.max()).bit_length()) if n else 1
        a = symbols.astype(np.uint16 if levels <= 16 else np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        nulls = np.array([d is None for d in doc_ids], np.uint8)
        values = np.array([0 if d is None else d for d in doc_ids], np.int64)
        blobs, zeros = [], np.zeros(levels, np.int64)
        for level in range(levels):
            bit = (a & a.dtype.type(1 << (levels - 1 - level))).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            step = RANK_BITS // 8
            padded = np.zeros(-(-len(packed) // step) * step, np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(1)
            samples = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
            low = np.compress(~bit, a)
            zeros[level] = len(low)
            a = np.concatenate([low, np.compress(bit, a)])
            frames = [pack(packed[k : k + FRAME].tobytes()) for k in range(0, len(packed), FRAME)]
            blobs += [struct.pack("<I", len(frames)) + np.cumsum([len(f) for f in frames]).astype("<u4").tobytes() + b"".join(frames), pack(samples.tobytes())]
        blobs = [pack(nulls.tobytes() + values.tobytes()), pack(np.asarray(lengths, np.int64).tobytes()), pack(zeros.tobytes()), *blobs]
        return MAGIC + struct.pack("<BQQ", levels, n, len(doc_ids)) + b"".join(struct.pack("<Q", len(b)) + b for b in blobs)

    def _bit(self, level: int, i: int) -> int:
        return int(self._piece(level, i >> 3, (i >> 3) + 1)[0] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, left = divmod(i, RANK_BITS)
        got, at = int(self._samples(level)[block]), block * RANK_BITS >> 3
        if not left:
            return got
        piece = self._piece(level, at, (i + 7) >> 3)
        got += int(np.bitwise_count(piece[: left >> 3]).sum())
        return got + (int(piece[left >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """The symbol at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value, i = value << 1 | bit, int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's occurrences among the first i start and end below the last plane."""
        lo, hi = 0, i
        for level in range(self.levels):
            l1, h1 = self._rank1(level, lo), self._rank1(level, hi)
            if symbol >> (self.levels - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + l1, int(self.zeros[level]) + h1
            else:
                lo, hi = lo - l1, hi - h1
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol among the first i."""
        if symbol < 0 or symbol >> self.levels:
            return 0
        lo, hi = self._range(symbol, min(max(i, 0), self.n))
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The position of the symbol's k-th occurrence, k from 0."""
        lo, hi = self._range(symbol, self.n) if 0 <= symbol < 1 << self.levels else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(self.levels)):
            one = symbol >> (self.levels - 1 - level) & 1
            want = i - int(self.zeros[level]) if one else i
            samples = self._samples(level).astype(np.int64)
            if not one:
                samples = np.minimum(np.arange(len(samples)) * RANK_BITS, self.n) - samples
            block = int(np.searchsorted(samples, want, "right")) - 1
            block = min(block, len(samples) - 2)
            at = block * RANK_BITS
            bits = np.unpackbits(self._piece(level, at >> 3, (at + RANK_BITS) >> 3), bitorder="little")[: self.n - at]
            i = at + int(np.flatnonzero(bits == one)[want - int(samples[block])])
        return i

    def symbols(self) -> np.ndarray:
        """All symbols in order: the planes' partitions undone from the lowest bit up."""
        out = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self._plane(level), count=self.n, bitorder="little").view(bool)
            z, up = int(self.zeros[level]), np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[:z]
            up[np.flatnonzero(bit)] = out[z:] | out.dtype.type(1 << (self.levels - 1 - level))
            out = up
        return out


def _build(path: str, end_id: int, shard_tokens: int, read_bytes: int, literal: bool):
    """Rows (doc_id, text) in order -> shard rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        enc, ids, docs, lengths, held = encoder(path, False, literal=literal), [], [], [], 0

        def flush():
            nonlocal shard, before, ids, docs, lengths, held
            image = WaveletMatrix.image(np.concatenate(ids), docs, np.concatenate(lengths))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([image], pa.binary())], ["part", "shard", "before", "n_docs", "n_tokens", "image"])
            shard, before, ids, docs, lengths, held = shard + 1, before + held, [], [], [], 0
            return row

        for batch in common.byte_slices(batches, "text", read_bytes):
            got, at = enc.encode(batch.column(1))
            n = np.diff(at) + 1
            full = np.full(len(got) + len(n), end_id, np.uint32)
            ends = np.cumsum(n)
            keep = np.ones(len(full), bool)
            keep[ends - 1] = False
            full[keep] = got
            names, a = batch.column(0).to_pylist(), 0
            while a < len(n):
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + shard_tokens - held, "right"))) if held < shard_tokens else a
                if b > a:
                    ids.append(full[done : int(ends[b - 1])])
                    docs += names[a:b]
                    lengths.append(n[a:b])
                    held += int(ends[b - 1]) - done
                    a = b
                if held >= shard_tokens or a < len(n):
                    yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, shard_tokens: int = 1 << 20, read_bytes: int = 8_000_000, literal: bool = False) -> None:
    """Encode docs (doc_id, text) and write shard images, ascending by doc_id over all shards, to `path`.

    `literal`: strings of added tokens in a text are ordinary text and not that token."""
    text = F.coalesce(F.col("text"), F.lit(""))
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(_build(vocabulary, end_id, shard_tokens, read_bytes, literal), SHARD_SCHEMA)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard rows (base, image) -> a row for each document with its ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        for base, image in zip(batch.column(0), batch.column(1)):
            matrix = WaveletMatrix(image.as_buffer().to_pybytes())
            ids, lengths = matrix.symbols().astype("<u4"), matrix.doc_lengths
            ends = np.concatenate([[0], np.cumsum(lengths)])
            values = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer((ends * 4).tobytes()), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(matrix.doc_ids, pa.int64()), pa.array(ends[:-1] + base.as_py(), pa.int64()), values.cast(pa.binary())], ["doc_id", "start", "ids"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), ids (little-endian uint32)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row for each partition that wrote, whatever the number of documents
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = shards.select("part", "before", "image").join(F.broadcast(base) if totals.count() <= BROADCAST_ROWS else base, "part")
    return rows.select((F.col("base") + F.col("before")).alias("base"), "image").mapInArrow(_decode, READ_SCHEMA)


def op5_token_shards(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    path = common.scratch(spark, "shards")
    write_shards(common.table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"), path)
    back = read_shards(spark, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
