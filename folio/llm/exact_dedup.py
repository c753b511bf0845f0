"""Exact dedup with Patricia-trie owners (operator 3).

Texts are equal when their bytes are equal after deleting `[\\x20\\x09-\\x0D]`. Each scan task first puts its
texts into a compressed radix trie and writes one entry per distinct text to the shared folder, so a text with
any number of copies leaves a task once. Entries are dealt by length and content hash; a trie over the full
byte strings gives each text its terminal node, which stores the owner (most code points, then smallest
doc_id) and the group's size. Entries arrive sorted by length and hash, so when the trie outgrows its budget
all subtrees but the current one are complete: they are sent on and freed.

Defined results: null text counts as empty; empty texts form one group; rows are counted as they are, so of
identical rows exactly one is kept; a null doc_id is larger than any other; an empty table gives no rows;
extra columns may have any names, dots and names used in here included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import common

ENTRY = "part int, seq long, key_len long, key_hash long, sha string, chars long, owner int, doc_id long, members array<long>"
OWNER = "part int, seq long, keep_id long, group_size long, owns boolean"


class Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes):
        self.label, self.kids, self.value = label, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:], by comparing halves."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Byte strings with shared prefixes stored once; node(key) finds or makes the key's terminal node."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def node(self, key: bytes) -> Node:
        node, at, n = self.root, 0, len(key)
        while at < n:
            kids = node.kids
            if kids is None:
                kids = node.kids = {}
            kid = kids.get(key[at])
            if kid is None:
                kid = kids[key[at]] = Node(key[at:])
                self.size += n - at
                return kid
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            cut = _common(kid.label, key, at)
            mid = Node(kid.label[:cut])
            kid.label = kid.label[cut:]
            mid.kids = {kid.label[0]: kid}
            kids[key[at]] = mid
            node, at = mid, at + cut
        return node

    def values(self) -> Iterator:
        """The values of all terminal nodes."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.value is not None:
                yield node.value
            if node.kids:
                stack.extend(node.kids.values())


def _before(chars: int, doc_id: int | None, other_chars: int, other_id: int | None) -> bool:
    """Whether the first row stays rather than the other."""
    if chars != other_chars:
        return chars > other_chars
    return doc_id is not None and (other_id is None or doc_id < other_id)


def _local(budget: int):
    """Rows of documents -> an entry for each distinct text among some tens of MB, with its owner's whole row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_worker()
        part, seq, held, rows, size, trie = TaskContext.get().partitionId(), 0, [], 0, 0, PatriciaTrie()

        def flush():
            nonlocal seq, held, rows, size, trie
            table = pa.Table.from_batches(held).combine_chunks()
            found = list(trie.values())
            owners = table.take(pa.array([v[2] for v in found], pa.int64())).combine_chunks().to_batches()[0]
            row = pa.StructArray.from_arrays(owners.columns, fields=list(owners.schema))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(found), part, np.int32)),
                    pa.array(np.arange(seq, seq + len(found), dtype=np.int64)),
                    *(pa.array(x, t) for x, t in zip(zip(*((v[4], v[5], v[6], v[0], v[7], v[1], v[3]) for v in found)), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))),
                    row,
                ],
                ["part", "seq", "key_len", "key_hash", "sha", "chars", "owner", "doc_id", "members", "row"],
            )
            seq, held, rows, size, trie = seq + len(found), [], 0, 0, PatriciaTrie()

        for batch in common.byte_slices(batches, "text", 4_000_000):
            text = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            chars = pc.utf8_length(text).to_pylist()
            ids = pc.cast(batch.column(batch.schema.get_field_index("doc_id")), pa.int64()).to_pylist()
            for k, raw in enumerate(pc.cast(text, pa.binary()).to_pylist()):
                key = raw.translate(None, common.SPACE)
                node, doc_id = trie.node(key), ids[k]
                v = node.value
                if v is None:
                    digest = hashlib.sha256(key)
                    # chars and id of the owner, its row, members, length, hash, digest, the owner's place among members
                    node.value = [chars[k], doc_id, rows + k, [doc_id], len(key), int.from_bytes(digest.digest()[:8], "big", signed=True), digest.hexdigest(), 0]
                else:
                    if _before(chars[k], doc_id, v[0], v[1]):
                        v[0], v[1], v[2], v[7] = chars[k], doc_id, rows + k, len(v[3])
                    v[3].append(doc_id)
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if size + trie.size > budget:
                yield from flush()
        if rows:
            yield from flush()

    return run


def _owners(budget: int):
    """Entries sorted by length and hash -> for each entry its group's owner and size."""

    def drain(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        out = [(part, seq, v[1], v[4], k == v[5]) for v in trie.values() for k, (part, seq) in enumerate(v[6])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["part", "seq", "keep_id", "group_size", "owns"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = PatriciaTrie(), None
        for batch in common.byte_slices(batches, "text", 8_000_000):
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            lists = [c[n].to_pylist() for n in ("part", "seq", "key_len", "key_hash", "chars", "doc_id", "n")]
            for part, seq, size, key_hash, chars, doc_id, n, raw in zip(*lists, pc.cast(c["text"], pa.binary()).to_pylist()):
                if trie.size > budget and (size, key_hash) != last:  # every subtree held is complete
                    yield from drain(trie)
                    trie = PatriciaTrie()
                last = size, key_hash
                key = size.to_bytes(8, "big") + key_hash.to_bytes(8, "big", signed=True) + raw.translate(None, common.SPACE)
                node = trie.node(key)
                v, at = node.value, (part, seq)
                if v is None:
                    node.value = [chars, doc_id, at, None, n, 0, [at]]
                else:
                    # of equal rows the first entry owns, whatever the order of arrival
                    if _before(chars, doc_id, v[0], v[1]) or (chars, doc_id) == (v[0], v[1]) and at < v[2]:
                        v[0], v[1], v[2], v[5] = chars, doc_id, at, len(v[6])
                    v[4] += n
                    v[6].append(at)
        yield from drain(trie)

    return run


def groups(docs: DataFrame, budget: int = 48_000_000) -> tuple[DataFrame, DataFrame]:
    """(entries, owners): distinct texts of each scan task with their members and the owner's row; and what owns each."""
    schema = T.StructType([*T._parse_datatype_string(ENTRY).fields, T.StructField("row", docs.schema)])
    entries = common.materialize(docs.mapInArrow(_local(budget), schema), "entries")
    keyed = entries.select("part", "seq", "key_len", "key_hash", "chars", "doc_id", F.size("members").cast("long").alias("n"), F.coalesce(F.col("row.text"), F.lit("")).alias("text"))
    dealt = keyed.repartition("key_len", "key_hash").sortWithinPartitions("key_len", "key_hash")
    return entries, dealt.mapInArrow(_owners(budget), OWNER)


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    entries, owners = groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = entries.select("part", "seq", "sha", "owner", "members").join(owners, ["part", "seq"])
    rows = rows.select("keep_id", "group_size", "owns", "sha", "owner", F.posexplode("members").alias("pos", "doc_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("owns") & (F.col("pos") == F.col("owner"))).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row owns; all columns as they were."""
    entries, owners = groups(common.plain_names(docs))
    kept = owners.filter("owns").select("part", "seq")
    return entries.join(kept, ["part", "seq"], "left_semi").select("row.*").toDF(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), r AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY k) AS group_size,
         row_number() OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(k) AS text_sha256 FROM r
"""
