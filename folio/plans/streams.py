"""Queries that run as streams over what the events hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.io import load
from folio.operators import reports
from folio.plans import queue  # noqa: F401  its replay is the oracle of the stream's
from folio.plans.registry import ORACLES, query
from folio.streaming import streams


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = load(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, d))


def _folder(spark: SparkSession, d: str) -> str:
    """A stream reads a folder: the table's events, written once to a folder of their own."""
    from folio.io import shared_path

    path = shared_path(spark, "events")
    load(spark, d, "events").write.parquet(path)
    return path


def _outcomes(events: DataFrame) -> DataFrame:
    """Results of renders: a user's events are a run, most of which fail."""
    outcome = F.when(F.col("event_type").isin("view", "click", "purchase"), "failed").when(F.col("event_type") == "signup", "rendered").otherwise("skipped")
    kind = F.when(F.col("user_id") % 3 == 0, F.lit("model")).otherwise(F.when(F.col("event_type") == "view", "voice").otherwise("model"))
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), outcome.alias("outcome"), kind.alias("kind"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS fingerprint FROM events GROUP BY 1")
def stream_ledger(spark, d):
    rows = _stream(spark, d).select(F.col("user_id").alias("id"), F.col("event_type").alias("fingerprint"), F.col("event_id").alias("line"))
    return streams.available_now(streams.ledger_stream(rows, "id", "fingerprint", "line"), "complete").select("id", "fingerprint")


@query("SELECT user_id AS run, max(ts) AS last_seen, epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(max(ts)) > 120 AS stale FROM events GROUP BY 1")
def stream_stale(spark, d):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    rows = _stream(spark, d).withColumnRenamed("user_id", "run")
    return streams.available_now(streams.heartbeat_stream(rows, "run", "ts", now), "complete").select("run", "last_seen", "stale")


_STOP = """
WITH o AS (SELECT user_id AS run, event_id AS place, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'failed' WHEN event_type = 'signup' THEN 'rendered' ELSE 'skipped' END AS outcome,
  CASE WHEN user_id % 3 = 0 THEN 'model' WHEN event_type = 'view' THEN 'voice' ELSE 'model' END AS kind FROM events),
w AS (SELECT run, place, count(*) FILTER (WHERE outcome = 'failed') OVER v AS f, count(*) FILTER (WHERE outcome = 'rendered') OVER v AS r, min(CASE WHEN outcome = 'failed' THEN kind END) OVER v AS a, max(CASE WHEN outcome = 'failed' THEN kind END) OVER v AS b
  FROM o WINDOW v AS (PARTITION BY run ORDER BY place ROWS UNBOUNDED PRECEDING))
SELECT run, min(place) AS stopped_at, arg_min(a, place) AS kind FROM w WHERE f >= 5 AND r = 0 AND a = b GROUP BY run
"""


@query(_STOP)
def systemic_stop(spark, d):
    return reports.systemic_stop(_outcomes(load(spark, d, "events")), "run", "place").select("run", "stopped_at", "kind")


@query(_STOP)
def stream_systemic(spark, d):
    found = streams.systemic_stream(_outcomes(_stream(spark, d)), "run", "place")
    return streams.available_now(found, "append").select("run", "stopped_at", "kind")


@query(ORACLES["queue_replay"])
def stream_transitions(spark, d):
    """The last state of each step; the same as the batch replay, which has the oracle."""
    found = streams.available_now(streams.transition_stream(moves_stream(spark, d), "slug", "event_id"), "update")
    return found.groupBy(F.col("item").alias("slug")).agg(F.max_by("status", "batch").alias("status"), F.max_by("n_events", "batch").alias("n_events"))


def moves_stream(spark: SparkSession, d: str) -> DataFrame:
    from folio.plans.queue import _MOVES

    table = F.create_map(*(F.lit(x) for kv in _MOVES.items() for x in kv))
    return _stream(spark, d).select(F.col("user_id").alias("slug"), "event_id", F.coalesce(table[F.col("event_type")], F.lit("none")).alias("event"))
