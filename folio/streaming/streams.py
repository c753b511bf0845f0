"""Time-driven state as streams.

Each function turns a streaming DataFrame into another; `available_now` runs one over what a source holds and
returns what it wrote. Clocks are arguments, so a replay gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.io import shared_path
from folio.operators.queueing import STALE_SECONDS, STATUSES, TRANSITIONS
from folio.operators.reports import SYSTEMIC_FAILURES


def ledger_stream(ledger: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """SC-12: of each id the value of its last line so far."""
    return ledger.groupBy(key).agg(F.max_by(value, place).alias(value))


def heartbeat_stream(events: DataFrame, group: str, time: str, now: Column) -> DataFrame:
    """TM-01: when each render was last heard of, and whether that is too long ago."""
    latest = events.groupBy(group).agg(F.max(time).alias("last_seen"))
    age = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("last_seen").cast("timestamp")) / 1e6
    return latest.withColumn("stale", age > STALE_SECONDS)


def systemic_stream(results: DataFrame, group: str, order: str) -> DataFrame:
    """QA-10: a row for each run at the failure that should have stopped it. State is three counters by run."""

    def watch(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, rendered, kinds, stopped = state.get if state.exists else (0, 0, "", False)
        rows = pd.concat(list(frames)).sort_values("place")
        out = []
        for place, outcome, kind in zip(rows["place"], rows["outcome"], rows["kind"]):
            if outcome == "rendered":
                rendered += 1
            elif outcome == "failed":
                failed += 1
                kinds = kind if kinds in ("", kind) else "\0"
            if not stopped and failed >= SYSTEMIC_FAILURES and not rendered and kinds != "\0":
                stopped = True
                out.append((key[0], int(place), kinds))
        state.update((failed, rendered, kinds, stopped))
        if out:
            yield pd.DataFrame(out, columns=["run", "stopped_at", "kind"])

    rows = results.select(F.col(group).alias("run"), F.col(order).alias("place"), "outcome", "kind")
    return rows.groupBy("run").applyInPandasWithState(watch, "run long, stopped_at long, kind string", "failed int, rendered int, kinds string, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def transition_stream(events: DataFrame, group: str, order: str) -> DataFrame:
    """TM-04: the state of each step after every batch of its events."""
    moves = {(event, source): to for event, source, to in TRANSITIONS}

    def apply(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (STATUSES[0], 0)
        rows = pd.concat(list(frames)).sort_values("place")
        for event in rows["event"]:
            status, n = moves.get((event, status), status), n + 1
        state.update((status, n))
        yield pd.DataFrame([(key[0], status, n)], columns=["item", "status", "n_events"])

    rows = events.select(F.col(group).alias("item"), F.col(order).alias("place"), "event")
    return rows.groupBy("item").applyInPandasWithState(apply, "item long, status string, n_events long", "status string, n_events long", "update", GroupStateTimeout.NoTimeout)


def available_now(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what its source holds; the result is a written table in the shared folder.

    Each batch has a folder of its own, so a batch that is run again after a failure replaces what it wrote."""
    spark: SparkSession = stream.sparkSession
    out, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")

    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)
