"""Queries of the work queue over events: a user is a book, its events are steps in order, the type gives the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.io import load
from folio.operators import queueing, windows
from folio.plans.registry import query

#: Event types in order stand for states.
_STATUS = {"click": "done", "view": "done", "purchase": "pending", "signup": "running", "error": "failed"}


def _sql_status(column: str = "event_type") -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())
    return f"CASE {column} {cases} ELSE 'pending' END"


#: The same table in SQL.
ITEMS = f"""
SELECT event_id AS id, user_id AS slug, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS position, event_type AS action, {_sql_status()} AS status, ts, value FROM events
"""


def items(spark: SparkSession, d: str) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv))
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("slug"), position.alias("position"), F.col("event_type").alias("action"), F.coalesce(table[F.col("event_type")], F.lit("pending")).alias("status"), "ts", "value")


@query(f"WITH i AS ({ITEMS}) SELECT id, slug, position FROM i WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM i p WHERE p.slug = i.slug AND p.position < i.position AND p.status <> 'done')")
def queue_ready(spark, d):
    return queueing.ready(items(spark, d)).select("id", "slug", "position")


@query(f"WITH i AS ({ITEMS}) SELECT id, slug FROM i WHERE status = 'pending' AND action <> 'view' AND NOT EXISTS (SELECT 1 FROM i p WHERE p.slug = i.slug AND p.position < i.position AND p.status <> 'done') ORDER BY id LIMIT 1")
def queue_claim(spark, d):
    return queueing.next_ready(items(spark, d), ("view",)).select("id", "slug")


@query(f"""
WITH i AS ({ITEMS}), b AS (SELECT i.id, i.slug, min(p.position) AS first FROM i JOIN i p ON p.slug = i.slug AND p.position < i.position AND p.status <> 'done' WHERE i.status <> 'done' GROUP BY 1, 2)
SELECT b.id, b.slug, p.id AS blocker_id, p.action AS blocker_action, p.status AS blocker_status FROM b JOIN i p ON p.slug = b.slug AND p.position = b.first
""")
def queue_blocked(spark, d):
    return queueing.blocked_by(items(spark, d))


@query(f"WITH i AS ({ITEMS}) SELECT {', '.join(f'''CAST(count(*) FILTER (WHERE status = '{s}') AS BIGINT) AS {s}''' for s in queueing.STATUSES)}, count(*) AS total, CAST(count(*) FILTER (WHERE status IN {queueing.OPEN}) AS BIGINT) AS open FROM i")
def queue_summary(spark, d):
    return queueing.summary(items(spark, d))


@query("SELECT user_id AS slug, min(event_id) AS first_id FROM events GROUP BY 1")
def queue_books(spark, d):
    return queueing.books(items(spark, d))


@query("""
SELECT user_id AS slug, CASE WHEN count(DISTINCT n) = 1 AND count(*) > 1 THEN max(n) ELSE '' END AS note FROM (SELECT user_id, CASE WHEN value > 50 THEN event_type END AS n FROM events) GROUP BY 1
""")
def queue_notes(spark, d):
    return queueing.shared_notes(items(spark, d).withColumn("note", F.when(F.col("value") > 50, F.col("action")).otherwise("")))


@query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT event_id AS id, CASE WHEN event_type = 'signup' AND epoch(now) - epoch(ts) > 120 THEN CASE WHEN user_id % 5 >= 3 THEN 'paused' ELSE 'pending' END WHEN event_type = 'signup' THEN 'claimed' ELSE 'done' END AS status FROM events, n
""")
def lease_expiry(spark, d):
    events = load(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "claimed").otherwise("done").alias("status"), F.lit("").alias("job_id"), F.lit("w").alias("claim"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("claimed_at"), (F.col("user_id") % 5).alias("attempts"))
    return queueing.expire_leases(rows.join(F.broadcast(now)), F.col("now")).select("id", "status")


@query("""
SELECT user_id AS slug, event_id AS id, CAST(coalesce(m.highest, -1) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS INTEGER) AS position
FROM events e LEFT JOIN (SELECT user_id AS u, CAST(max(event_id % 100) AS INTEGER) AS highest FROM events WHERE event_id % 2 = 0 GROUP BY 1) m ON m.u = e.user_id WHERE event_id % 2 = 1
""")
def position_assign(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("slug"), F.col("event_id").alias("id"))
    existing = rows.filter("id % 2 = 0").select("slug", (F.col("id") % 100).cast("int").alias("position"))
    return windows.assign_positions(rows.filter("id % 2 = 1"), existing, "slug", "id").select("slug", "id", F.col("position").cast("int").alias("position"))


@query(f"WITH i AS ({ITEMS}) SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM i")
def queue_retry(spark, d):
    return queueing.apply_event(items(spark, d), "retry").select("id", "status")


@query(f"WITH i AS ({ITEMS}) SELECT id, CASE WHEN status = 'running' THEN CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'pending' END ELSE status END AS status FROM i")
def queue_settle(spark, d):
    rows = items(spark, d).withColumn("job_id", F.col("id"))
    n = F.col("id") % 4
    jobs = rows.select("job_id", F.when(n == 0, 0).when(n == 1, 1).alias("exit_code"), (n == 2).alias("alive"))
    return queueing.settle(rows, jobs).select("id", "status")


@query("""
SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'running' ELSE 'succeeded' END AS state, event_type = 'view' AND epoch(now) - epoch(ts) > 120 AS stale FROM events, (SELECT max(ts) AS now FROM events)
""")
def job_states(spark, d):
    events = load(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    state = queueing.job_state(F.when(F.col("event_type") != "view", 0), F.lit(True))
    rows = events.join(F.broadcast(now)).withColumn("state", state)
    return rows.select(F.col("event_id").alias("id"), "state", queueing.is_stale(F.col("state"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.col("now")).alias("stale"))


@query("""
SELECT id, rank FROM (SELECT event_id AS id, user_id % 7 AS g, CAST(row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events WHERE event_type <> 'view') WHERE rank > 20
""")
def retention(spark, d):
    jobs = load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("g"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"))
    return windows.expired(jobs, "g").select("id", "rank")


#: Event types as moves of a step.
_MOVES = {"view": "claim", "click": "start", "purchase": "finish", "signup": "fail", "error": "retry"}


def moves(spark: SparkSession, d: str) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in _MOVES.items() for x in kv))
    return load(spark, d, "events").select(F.col("user_id").alias("slug"), "event_id", F.coalesce(table[F.col("event_type")], F.lit("none")).alias("event"))


_STEP = " ".join(f"WHEN e.event = '{event}' AND r.status = '{source}' THEN '{to}'" for event, source, to in queueing.TRANSITIONS)


@query(f"""
WITH RECURSIVE e AS (SELECT user_id AS slug, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MOVES.items())} ELSE 'none' END AS event FROM events),
r AS (SELECT DISTINCT slug, CAST(0 AS BIGINT) AS n, 'pending' AS status FROM e UNION ALL SELECT e.slug, e.n, CASE {_STEP} ELSE r.status END FROM r JOIN e ON e.slug = r.slug AND e.n = r.n + 1)
SELECT slug, arg_max(status, n) AS status, max(n) AS n_events FROM r GROUP BY slug
""")
def queue_replay(spark, d):
    return queueing.replay(moves(spark, d))
