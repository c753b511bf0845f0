"""Queries of the remaining operators, over whichever table has their shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.io import load
from folio.operators import backends, catalog, checks, queueing, reports, roles, windows
from folio.plans.queue import ITEMS, items
from folio.plans.registry import query
from folio.sources import tables


@query("SELECT n_nationkey AS id, lower(n_name) LIKE 'in%' AS front FROM nation")
def front_matter(spark, d):
    title = F.concat(F.when(F.upper("n_name").startswith("IN"), "Index of ").otherwise("Chapter "), F.col("n_name"))
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), tx.is_front_matter(title).alias("front"))


@query("SELECT page_id, page_id % 3 <> 0 AS inside FROM pages")
def contained_paths(spark, d):
    path = F.concat(F.lit("/data/books/"), F.when(F.col("page_id") % 3 == 0, "../").otherwise("a/"), F.col("page_id").cast("string"))
    return load(spark, d, "pages").select("page_id", tx.is_contained(F.lit("/data/books"), path).alias("inside"))


@query("SELECT p_partkey AS key, replace(lower(p_brand), '#', '') || '-x-y' AS speaker FROM part")
def speaker_keys(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), roles.normalise_speaker(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" X_y! "))).alias("speaker"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'utf-32' ELSE 'cp1250' END AS family FROM documents")
def encoding_families(spark, d):
    name = F.when(F.col("doc_id") % 4 == 0, "UTF_8-sig").when(F.col("doc_id") % 4 == 1, "utf-16-le").when(F.col("doc_id") % 4 == 2, "UTF-32").otherwise("CP1250")
    return load(spark, d, "documents").select("doc_id", tx.encoding_family(name).alias("family"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def set_difference(spark, d):
    planned = load(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return checks.set_difference(planned, load(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("id")), "id")


@query("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def already_imported(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return checks.already_imported(rows, rows.filter("doc_id % 2 = 0")).select("doc_id")


@query("SELECT o_custkey AS book FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 9 = 0) = 0")
def archivable(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book"), F.col("o_orderpriority").alias("text"))
    plan = rows.withColumn("text", F.when(F.col("id") % 9 == 0, "other").otherwise(F.col("text")))
    return catalog.archivable(rows, plan)


@query("""
SELECT c_custkey AS run, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE p.plan END AS plan_id FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS plan FROM orders GROUP BY 1) p ON p.o_custkey = c_custkey
""")
def attached_plans(spark, d):
    runs = load(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.col("c_custkey").alias("text_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit(-1).cast("long")).alias("plan_id"))
    plans = load(spark, d, "orders").select(F.col("o_custkey").alias("text_id"), F.col("o_orderkey").alias("plan_id"), F.col("o_orderdate").alias("created_at"))
    return catalog.attach_plan(runs, plans).select("run", "plan_id")


@query(f"WITH i AS ({ITEMS}) SELECT id, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status FROM i")
def restored_queue(spark, d):
    return items(spark, d).select("id", catalog.restored_status(F.col("status")).alias("status"))


@query(f"WITH i AS ({ITEMS}) SELECT id, CASE WHEN slug % 4 = 0 AND status = 'pending' THEN 'paused' ELSE status END AS status FROM i")
def pause_books(spark, d):
    rows = items(spark, d)
    return queueing.apply_event(rows, "pause", rows.filter("slug % 4 = 0")).select("id", "status")


@query("SELECT doc_id FROM documents WHERE doc_id % 6 = 0")
def damaged_assets(spark, d):
    content = F.col("text").cast("binary")
    name = F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text")), 256)
    return catalog.damaged(load(spark, d, "documents").select("doc_id", content.alias("content"), name.alias("sha256"))).select("doc_id")


@query("""
SELECT source, CASE WHEN n > 5 THEN array_to_string(ids[1:5], ', ') || ' and ' || (n - 5) || ' more' ELSE array_to_string(ids, ', ') END AS listed
FROM (SELECT source, list_sort(list(CAST(doc_id AS VARCHAR))) AS ids, count(*) AS n FROM documents GROUP BY source)
""")
def listed_ids(spark, d):
    ids = F.collect_list(F.col("doc_id").cast("string"))
    return load(spark, d, "documents").groupBy("source").agg(windows.listed(ids).alias("listed"))


@query("SELECT source, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 10")
def first_findings(spark, d):
    rows = load(spark, d, "documents").select("source", "doc_id", "n_chars")
    return windows.first_k(rows, "source", [F.col("n_chars").desc(), "doc_id"], 10).select("source", "doc_id", "rank")


@query("""
SELECT c_custkey AS slug, o.n AS outputs, s_name AS report, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS percent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def book_views(spark, d):
    customers = load(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_acctbal").alias("percent"))
    meta = customers.select("slug")
    report = load(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_name").alias("report"))
    progress = customers.filter("slug % 4 = 0")
    outputs = load(spark, d, "orders").select(F.col("o_custkey").alias("slug"))
    return tables.book_view(meta, report, progress, outputs).select("slug", "outputs", "report", "percent")


@query("""
SELECT event_id AS id, event_type AS action, CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'missing slug' WHEN event_type = 'view' THEN 'unsafe argument' ELSE 'unknown action' END AS reason
FROM events WHERE event_type <> 'click' AND NOT (event_type = 'view' AND user_id % 3 = 0 AND user_id % 2 = 1)
""")
def action_problems(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    action = F.when(kind == "click", "chunk").when(kind == "view", "synth").otherwise("format")
    slug = F.when((kind == "view") & (user % 2 == 0), "").when((kind == "view") & (user % 3 != 0), "../etc").otherwise("book")
    rows = load(spark, d, "events").select(F.col("event_id").alias("id"), action.alias("action"), F.create_map(F.lit("slug"), slug).alias("args"), kind.alias("kind"))
    found = backends.action_problems(rows)
    return found.join(rows.select("id", "kind"), "id").select("id", F.col("kind").alias("action"), "reason")


@query("SELECT item_id AS id, true AS ok, floor(greatest(length(text) / 15.0, 0.2) * 100) / 100 AS seconds, 0.0 AS peak FROM benchmark")
def silent_render(spark, d):
    plan = load(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.lit("en").alias("language"), F.lit("v").alias("voice"))
    return backends.render(plan, "silence").select(F.col("id").cast("long").alias("id"), "ok", "seconds", "peak")


@query("SELECT p_partkey AS key, 16 * p_size + 536870912 <= 536870912 + 400 AS room FROM part")
def disk_room(spark, d):
    needed = F.col("p_size").cast("long") * 16
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), reports.has_room(needed, F.lit(reports.RESERVE + 400)).alias("room"))


@query("SELECT doc_id AS id, round(greatest(n_chars / 3000.0, 0.2), 3) AS duration_sec FROM documents")
def dry_run(spark, d):
    plan = load(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 3000.0).alias("est_seconds"), F.col("source").alias("voice"))
    return tables.dry_run(plan, plan.select("voice"))[0].select("id", "duration_sec")


@query("SELECT DISTINCT source AS voice FROM documents WHERE source NOT IN ('src0', 'src1', 'src2')")
def missing_voices(spark, d):
    plan = load(spark, d, "documents").select(F.col("n_chars").cast("double").alias("est_seconds"), F.col("source").alias("voice"))
    return tables.dry_run(plan, plan.filter(F.col("voice").isin("src0", "src1", "src2")).select("voice"))[1]
