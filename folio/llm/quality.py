"""Quality classifier by nearest-neighbour voting in a latent-semantic space (operator 8).

Terms of a document are its byte trigrams and its words and pairs of neighbouring words (A-Z lower-cased), hashed
into LETTERS and WORDS places, and the repetition of a word by itself as a term of its own. A term weighs the root
of its share of the document times its inverse document frequency, learnt from the sample. The truncated singular
value decomposition of the centred sample spans the latent space. The sample's vectors and labels are sent to every
task; each document is compared with all of them by exact cosine products in blocks, and its `k` nearest vote with
weights similarity ** power. Similarity is the cosine of the whole document with the labelled vector, what lies
outside the latent space included, and `prior` of undecided votes is added: a text made of unknown terms is like
none of the labelled ones and comes out undecided, whatever its shape.

Labels are learnt only from rows that `learn` allows; labels, lang, source and doc_id are never inputs of a
score. The sample takes at most `sample` rows, those of least hash of their id: the only bound on input here.

Defined results: null text counts as empty, and empty texts have a score like any other; null labels and rows or
labels without an id are not learnt; repeated labels or documents count as often as they are there (within the
sample's bound); every row, one with a null id too, is scored on its own; without any label every score is 0.5; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.words import hash_words, mix

LETTERS, WORDS = 4096, 4096  # places of byte trigrams, and of words and their pairs
TERMS = LETTERS + WORDS + 1  # the last: a word that repeats the one before
SAMPLE = 4096  # labelled documents at most
ROWS = 512  # documents whose terms are held as one dense block
SPARE = 64  # directions beyond those kept, which make the decomposition exact for small samples and sharper for others


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Places of the byte trigrams of data, by their first byte."""
    d = data.astype(np.uint32)
    key = d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)
    return ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)


def _places(hashes: np.ndarray) -> np.ndarray:
    return LETTERS + (hashes >> np.uint64(52)).astype(np.int64)


def counts(texts: pa.Array, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """float32 rows of TERMS counts, and the number of trigrams and words of each text. Texts are read whole, in
    pieces of so many bytes."""
    n = len(texts)
    raw = pa.concat_arrays([texts.cast(pa.large_binary())])
    at = np.frombuffer(raw.buffers()[1], np.int64, n + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] and at[-1] else np.zeros(0, np.uint8)
    out = np.zeros(n * TERMS, np.float32)
    for a in range(int(at[0]), max(int(at[0]), int(at[-1]) - 2), piece):
        b = min(a + piece, int(at[-1]) - 2)
        # the text of each trigram's first byte; a trigram across two texts counts for none
        first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b, "left"))
        doc = np.repeat(np.arange(last - first), np.diff(np.clip(at[first : last + 1], a, b)))
        inner = np.ones(b - a, bool)
        for back in (1, 2):
            cut = at[first + 1 : last + 1] - back - a
            inner[cut[(cut >= 0) & (cut < b - a)]] = False
        out[first * TERMS : last * TERMS] += np.bincount((doc * TERMS + _trigrams(data[a : b + 2]))[inner], minlength=(last - first) * TERMS)
    hashes, said = hash_words(texts)
    doc = np.repeat(np.arange(n), said)
    with np.errstate(over="ignore"):
        pair = mix(mix(hashes[:-1]) + hashes[1:])
    together, again = doc[1:] == doc[:-1], hashes[1:] == hashes[:-1]
    keys = [doc * TERMS + _places(hashes), (doc[1:] * TERMS + np.where(again, TERMS - 1, _places(pair)))[together]]
    out += np.bincount(np.concatenate(keys), minlength=n * TERMS)
    return out.reshape(n, TERMS), np.stack([np.maximum(np.diff(at) - 2, 0), said], 1)


def _shares(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Roots of each term's share of its text, in place. A single repeat in a few words is no sign of junk."""
    letters, words = sizes[:, :1].astype(np.float32), sizes[:, 1:].astype(np.float32)
    x[:, :LETTERS] /= np.maximum(letters, 1)
    x[:, LETTERS:-1] /= 2 * np.maximum(words, 1)
    x[:, -1:] /= words + 20
    return np.sqrt(x, out=x)


class Sample:
    """Term counts of labelled documents, held sparse and read as dense blocks."""

    def __init__(self, rows: list[bytes], sizes: np.ndarray):
        self.rows, self.sizes = rows, np.asarray(sizes, np.int64).reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.rows)

    @staticmethod
    def pack(row: np.ndarray) -> bytes:
        """Places (16 bits) and then counts (32 bits) of the terms that are there."""
        at = np.flatnonzero(row)
        return at.astype("<u2").tobytes() + row[at].astype("<u4").tobytes()

    def blocks(self) -> Iterator[np.ndarray]:
        """Blocks of shares, row after row."""
        for a in range(0, len(self.rows), ROWS):
            some = self.rows[a : a + ROWS]
            x = np.zeros((len(some), TERMS), np.float32)
            for k, raw in enumerate(some):
                n = len(raw) // 6
                x[k, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<u4", n, 2 * n)
            yield _shares(x, self.sizes[a : a + ROWS])


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, sample: Sample, labels: np.ndarray, dims: int = 32, k: int = 15, power: int = 4, prior: float = 0.01, rounds: int = 4):
        n = len(sample)
        self.k, self.power, self.prior, self.labels = min(k, n), power, prior, labels.astype(np.float32)
        seen = sum(((x > 0).sum(0) for x in sample.blocks()), np.zeros(TERMS, np.int64))
        self.idf = (np.log((n + 1) / (seen + 1)) + 1).astype(np.float32)
        self.mean = sum((self._unit(x).sum(0, dtype=np.float64) for x in sample.blocks()), np.zeros(TERMS)).astype(np.float32) / np.float32(max(1, n))
        # randomised decomposition: the leading directions, sharpened by passes over the sample
        q = np.random.default_rng(8).standard_normal((TERMS, dims + SPARE)).astype(np.float32)
        for _ in range(rounds if n else 0):
            q = sum(z.T @ (z @ q) for z in self._centred(sample))
            q, _ = np.linalg.qr(q)
        inner = sum((w.T @ w for w in (z @ q for z in self._centred(sample))), np.zeros((dims + SPARE,) * 2, np.float32))
        _, turn = np.linalg.eigh(inner.astype(np.float64))
        self.axes = (q @ turn[:, ::-1][:, :dims]).astype(np.float32)
        self.shift = self.mean @ self.axes
        found = [self._unit(x) @ self.axes - self.shift for x in sample.blocks()]
        v = np.concatenate(found) if found else np.zeros((0, dims), np.float32)
        self.vectors = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)

    def _unit(self, shares: np.ndarray) -> np.ndarray:
        """Weighted terms as unit vectors, in place; a text without terms stays at 0."""
        shares *= self.idf
        shares /= np.linalg.norm(shares, axis=1, keepdims=True) + 1e-9
        return shares

    def _centred(self, sample: Sample) -> Iterator[np.ndarray]:
        for x in sample.blocks():
            yield self._unit(x) - self.mean

    def similarities(self, shares: np.ndarray) -> np.ndarray:
        """Cosines of the documents with all labelled vectors."""
        x = self._unit(shares)
        # |x - mean|, by its square
        whole = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x) - 2 * (x @ self.mean) + self.mean @ self.mean, 1e-12))
        return ((x @ self.axes - self.shift) / whole[:, None]) @ self.vectors.T

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scores of whole texts, none of them null."""
        out = np.full(len(texts), 0.5)
        for a in range(0, len(texts) if self.k else 0, ROWS):
            near = self.similarities(_shares(*counts(texts[a : a + ROWS])))
            at = np.argpartition(-near, self.k - 1, axis=1)[:, : self.k]
            weight = np.maximum(np.take_along_axis(near, at, 1).astype(np.float64), 0) ** self.power
            out[a : a + ROWS] = ((weight * self.labels[at]).sum(1) + self.prior / 2) / (weight.sum(1) + self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, **options) -> Model:
    """A model from the labelled rows (doc_id, quality) for which learn holds, and their texts in docs."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(learn)
    # bounded by the sample, so it can go to every task of the scan
    some = F.broadcast(labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    rows = common.plain_names(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(some, "doc_id")
    names = ["doc_id", "quality", "letters", "words", "terms"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker()
        for batch in common.byte_slices(batches, "text", 2_000_000):
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x, sizes = counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(s) for s in sizes.T), pa.array([Sample.pack(r) for r in x], pa.binary())], names)

    found = rows.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, letters long, words long, terms binary")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "terms").limit(sample).toArrow()
    sizes = np.stack([got.column(c).to_numpy() for c in ("letters", "words")], 1)
    model = Model(Sample(got.column("terms").to_pylist(), sizes), got.column("quality").to_numpy(), **options)
    common.trim()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The model's score of each row of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker()
        for batch in common.byte_slices(batches, "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", "score"])

    rows = common.plain_names(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score below 0.5; all columns as they were, whatever their names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker()
        for batch in common.byte_slices(batches, "text", 2_000_000):
            texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            yield batch.filter(pa.array(model.scores(texts) >= 0.5))

    rows = common.plain_names(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = common.crc_mod("doc_id", 3) == 1
    found = scored(docs, fit(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
