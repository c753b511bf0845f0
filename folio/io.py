"""Tables of a folder, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or in local mode below a folder of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folio-shared-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get()
    return f"{base.rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"


def in_pieces(rows: Iterable, made: Callable, kind: pa.DataType, limit: int = 1_000_000) -> pa.Array:
    """made(row) of each row as one array; of what is made, only about `limit` bytes or characters stand as Python
    objects at a time. made gives a value and its size."""
    done, values, held = [], [], 0
    for row in rows:
        value, size = made(row)
        values.append(value)
        held += size
        if held > limit:
            done.append(pa.array(values, kind))
            values, held = [], 0
    return pa.concat_arrays([*done, pa.array(values, kind)])


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch without a copy, of about `limit` bytes of the string column each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)
