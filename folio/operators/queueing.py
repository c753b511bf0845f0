"""The work queue as queries over a table of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a step, those still open, and the limits of a claim and of a render's silence in seconds.
STATUSES = ("pending", "claimed", "running", "paused", "done", "failed", "cancelled")
OPEN = ("pending", "claimed", "running", "paused")
LEASE_SECONDS, MAX_CLAIMS, STALE_SECONDS = 120, 3, 120

#: (event, from, to): the moves a step may make.
TRANSITIONS = [
    ("claim", "pending", "claimed"),
    ("start", "claimed", "running"),
    ("finish", "claimed", "done"),
    ("finish", "running", "done"),
    ("fail", "claimed", "failed"),
    ("fail", "running", "failed"),
    ("release", "claimed", "pending"),
    ("release", "running", "pending"),
    ("pause", "pending", "paused"),
    ("resume", "paused", "pending"),
    ("cancel", "pending", "cancelled"),
    ("cancel", "paused", "cancelled"),
    ("retry", "failed", "pending"),
    ("retry", "cancelled", "pending"),
]


def ready(items: DataFrame, skip_actions: tuple[str, ...] = ()) -> DataFrame:
    """JN-04: pending steps none of whose book's earlier steps is open.

    Whether an earlier step is open needs only the book's first open position, so the anti join on an inequality
    is one aggregate by book and a join on equality."""
    first = items.filter(F.col("status") != "done").groupBy("slug").agg(F.min("position").alias("first_open"))
    found = items.filter(F.col("status") == "pending").join(first, "slug").filter(F.col("position") <= F.col("first_open")).drop("first_open")
    return found.filter(~F.col("action").isin(*skip_actions)) if skip_actions else found


def next_ready(items: DataFrame, skip_actions: tuple[str, ...] = ()) -> DataFrame:
    """TM-03: the step a worker would claim."""
    return ready(items, skip_actions).orderBy("id").limit(1)


def blocked_by(items: DataFrame) -> DataFrame:
    """JN-13: for each open step the first earlier step of its book that is not done."""
    w = Window.partitionBy("slug").orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    blocker = F.min(F.when(F.col("status") != "done", F.struct("position", "id", "action", "status"))).over(w)
    return items.withColumn("_b", blocker).filter((F.col("status") != "done") & F.col("_b").isNotNull()).select("id", "slug", F.col("_b.id").alias("blocker_id"), F.col("_b.action").alias("blocker_action"), F.col("_b.status").alias("blocker_status"))


def summary(items: DataFrame) -> DataFrame:
    """AG-01: one row with a count for every state, the total and what is open."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return items.agg(*counts, F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*OPEN)).alias("open"))


def books(items: DataFrame) -> DataFrame:
    """AG-02: books in the order they were queued."""
    return items.groupBy("slug").agg(F.min("id").alias("first_id")).orderBy("first_id")


def shared_notes(items: DataFrame) -> DataFrame:
    """AG-13: the note that all of a book's steps with a note share, if it has several steps."""
    notes = F.collect_set(F.when(F.coalesce("note", F.lit("")) != "", F.col("note")))
    grouped = items.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), notes.alias("notes"))
    return grouped.select("slug", F.when((F.size("notes") == 1) & (F.col("n") > 1), F.col("notes")[0]).otherwise("").alias("note"))


def age_seconds(timestamp: Column, now: Column) -> Column:
    """TM-01: seconds since an ISO timestamp, taken as UTC unless it says otherwise; null if it is none."""
    return F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(timestamp.try_cast("timestamp")) / 1e6


def is_stale(status: Column, updated: Column, now: Column) -> Column:
    """TM-01: a render that says it runs but has not been heard of."""
    return (status == "running") & F.coalesce(age_seconds(updated, now) > STALE_SECONDS, F.lit(False))


def expire_leases(items: DataFrame, now: Column) -> DataFrame:
    """TM-02: claims that never started go back, or are held after too many."""
    lapsed = (F.col("status") == "claimed") & (F.coalesce("job_id", F.lit("")) == "") & (age_seconds(F.col("claimed_at").cast("string"), now) > LEASE_SECONDS)
    status = F.when(lapsed & (F.col("attempts") >= MAX_CLAIMS), "paused").when(lapsed, "pending").otherwise(F.col("status"))
    return items.withColumns({"status": status, "claim": F.when(lapsed, "").otherwise(F.col("claim")), "claimed_at": F.when(~lapsed, F.col("claimed_at"))})


def allowed_from(event: str) -> list[str]:
    return [source for name, source, _ in TRANSITIONS if name == event]


def apply_event(items: DataFrame, event: str, ids: DataFrame | None = None) -> DataFrame:
    """TM-04, TM-05: a move of the given steps, or of all, where their state allows it."""
    target = next(to for name, _, to in TRANSITIONS if name == event)
    moves = F.col("status").isin(*allowed_from(event))
    if ids is not None:
        items = items.join(ids.select("id", F.lit(True).alias("_asked")).distinct(), "id", "left")
        moves = moves & F.coalesce("_asked", F.lit(False))
    return items.withColumn("status", F.when(moves, target).otherwise(F.col("status"))).drop("_asked")


def replay(events: DataFrame, group: str = "slug", order: str = "event_id") -> DataFrame:
    """TM-04: the state of each step after its events in order; events its state does not allow change nothing.

    The table of moves composes like a function, so a step's events fold into one array state -> state."""
    codes = {s: k for k, s in enumerate(STATUSES)}

    def after(state: Column, event: Column) -> Column:
        out = state
        for name, source, to in TRANSITIONS:
            out = F.when((event == name) & (state == codes[source]), F.lit(codes[to])).otherwise(out)
        return out

    ordered = events.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "event"))), lambda e: e["event"]).alias("events"))
    names = F.array(*(F.lit(s) for s in STATUSES))
    state = F.aggregate("events", F.lit(codes["pending"]), after)
    return ordered.select(group, F.element_at(names, state + 1).alias("status"), F.size("events").cast("long").alias("n_events"))


def job_state(exit_code: Column, alive: Column) -> Column:
    """TM-07: what became of a job."""
    return F.when(exit_code == 0, "succeeded").when(exit_code.isNotNull(), "failed").when(alive, "running").otherwise("orphaned")


def settle(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """TM-06: running steps take over the end of their job: done, failed, or back to pending if it was lost."""
    known = jobs.select("job_id", job_state(F.col("exit_code"), F.col("alive")).alias("_job"))
    rows = items.join(known, "job_id", "left")
    running = F.col("status") == "running"
    status = F.when(running & (F.col("_job") == "succeeded"), "done").when(running & (F.col("_job") == "failed"), "failed").when(running & (F.col("_job") == "orphaned"), "pending").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_job")


def book_state(running: Column, stale: Column, dry_run: Column, report_ok: Column, outputs: Column) -> Column:
    """TM-09: one word for where a book stands."""
    return F.when(running & stale, "stale").when(running, "rendering").when(dry_run, "silence").when(~report_ok, "failed").when(outputs > 0, "done").when(report_ok.isNotNull(), "rendered").otherwise("prepared")


def blocking_problems(needs_review: Column, language: Column, readers: Column) -> Column:
    """TM-10: why a book cannot be queued."""
    found = F.array(F.when(needs_review, "left for review"), F.when(F.coalesce(language, F.lit("")) == "", "no language"), F.when(F.size(readers) == 0, "no voice"))
    return F.filter(found, lambda x: x.isNotNull())


def readers(voice: Column, cast: Column, fallback: Column) -> Column:
    """TM-10: who would read a book: its voice, else its cast, else the default cast."""
    named = lambda m: F.array_sort(F.array_distinct(F.filter(F.map_values(m), lambda v: F.coalesce(v, F.lit("")) != "")))
    return F.when(F.coalesce(voice, F.lit("")) != "", F.array(voice)).when(F.size(named(cast)) > 0, named(cast)).otherwise(named(fallback))
