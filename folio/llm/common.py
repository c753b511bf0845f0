"""Shared folder, column and partition helpers for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, `[\x20\x09-\x0D]`: exactly what bytes.split() and bytes.translate() see here.
SPACE = b" \t\n\x0b\x0c\r"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="folio-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered for release()."""
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def made() -> list[str]:
    """Paths of the scratch tables made so far in this process."""
    return [path for _, path in _scratch]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables whose readers are done."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _scratch[:] = [x for x in _scratch if x[1] != path]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """materialize(), with aggregates of the rows that were gathered while they were written.

    A task that is run again may be counted again, so these may steer the work but not enter results."""
    seen = Observation()
    table = materialize(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), name)
    return table, seen.get


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop what finished plans hold; Spark's cleaner then deletes their shuffle files and broadcasts."""
    trim()
    spark._jvm.System.gc()


def trim() -> None:
    """Give this process's unused memory back."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


#: What a Python worker keeps from task to task, by module: tables that only their own operator's tasks need.
worker_caches: list[dict] = []


def free_worker(keep: dict | None = None) -> None:
    """Drop what other tasks left in this Python worker, all caches but `keep`, and give the memory back."""
    left = [cache for cache in worker_caches if cache and cache is not keep]
    if left:
        for cache in left:
            cache.clear()
        trim()


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(docs: DataFrame) -> DataFrame:
    """docs with its columns doc_id and text, and names that no operator uses for all others, whatever theirs are.

    toDF(*docs.columns) gives them their names back."""
    return docs.toDF(*(name if name in ("doc_id", "text") else f"extra_{k}" for k, name in enumerate(docs.columns)))


#: Keys that hub_join broadcasts at most, some tens of bytes each.
HUBS = 8192


def hub_bound(rows: int, least: int = 200) -> int:
    """So many rows of one key make it a hub: of `rows` rows, HUBS keys at most have more."""
    return max(least, -(-rows // HUBS))


def hub_join(rows: DataFrame, facts: DataFrame, key: str, size: str, bound: int, most: int | None = None) -> DataFrame:
    """rows joined with facts (one row a key; `size`: how many of the rows have it).

    Keys of more than `bound` rows are not dealt by key: their facts are broadcast. hub_bound() gives a bound that
    keeps their number below HUBS whatever the input. `most`: the largest size, where it is known; there may be no hub."""
    if most is not None and most <= bound:
        return rows.join(facts, key)
    hubs = F.broadcast(facts.filter(F.col(size) > bound))
    rest = rows.join(hubs.select(key), key, "left_anti").join(facts.filter(F.col(size) <= bound), key)
    return rows.join(hubs, key).unionByName(rest)


#: Bytes of a table that Spark may broadcast of itself. It goes by the size of files, where a row takes a byte or two, and
#: on the driver it takes seventy: with Spark's own 10 MB, a row for each of some million documents.
BROADCAST_BYTES = 256 * 1024


@contextlib.contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Jobs that run in here broadcast what the operator names, and else BROADCAST_BYTES at most; other joins shuffle."""
    key, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    now = {key: spark.conf.get(key), adaptive: spark.conf.get(adaptive, None)}  # the second, if unset, is as the first
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    large = [k for k, value in now.items() if value and not value.startswith("-") and size(value) > BROADCAST_BYTES]
    was = {k: spark.conf.get(k, None) for k in large}
    for k in large:
        spark.conf.set(k, str(BROADCAST_BYTES))
    try:
        yield
    finally:
        for k, value in was.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with about `limit` bytes of the binary or string column each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
