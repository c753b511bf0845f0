"""Queries of fragments, checks, windows and reports over line items, orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import quality
from folio.io import load
from folio.operators import catalog, checks, reports, windows
from folio.plans.registry import query


def _lines(spark: SparkSession, d: str, *more) -> DataFrame:
    key = F.format_string("%d_%d", "l_orderkey", "l_linenumber").alias("id")
    return load(spark, d, "lineitem").select(key, F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("order"), *more)


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus <> 'P'")
def stale_fragments(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("q"), (F.col("o_orderstatus") == "P").alias("blank"))
    rendered = rows.select("id", F.when(F.col("blank"), "").otherwise(F.sha2(F.col("q").cast("string"), 256)).alias("fingerprint"))
    planned = rows.select("id", F.sha2(F.when(F.col("q") % 10 == 3, "x").otherwise(F.col("q").cast("string")), 256).alias("expected"))
    return checks.stale_fragments(rendered, planned).select("id")


@query("""
WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem), p AS (SELECT id FROM f WHERE id % 11 <> 0), r AS (SELECT id FROM f WHERE id % 7 <> 0 UNION ALL SELECT id FROM f WHERE id % 13 = 0)
SELECT 'duplicate' AS problem, id FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'missing', id FROM (SELECT DISTINCT id FROM p) WHERE id NOT IN (SELECT id FROM r)
UNION ALL SELECT 'unknown', id FROM (SELECT DISTINCT id FROM r) WHERE id NOT IN (SELECT id FROM p)
UNION ALL SELECT 'no file', id FROM r WHERE id % 17 = 0
""")
def completeness(spark, d):
    fragments = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    made = fragments.withColumn("audio_path", F.col("id"))
    rendered = made.filter("id % 7 <> 0").unionByName(made.filter("id % 13 = 0"))
    return checks.completeness_problems(rendered, fragments.filter("id % 11 <> 0"), made.filter("id % 17 <> 0").select("audio_path").distinct())


@query("SELECT o_orderkey AS id, o_custkey % 5 = 0 AS moved, o_custkey % 8 = 0 AS rechaptered FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 8 = 0")
def ordering_problems(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("chapter_index"), F.col("o_custkey").alias("q"))
    planned = rows.select("id", F.when(F.col("q") % 5 == 0, F.col("order") + 1).otherwise(F.col("order")).alias("order"), F.when(F.col("q") % 8 != 0, F.col("chapter_index")).alias("chapter_index"))
    return checks.ordering_problems(rows.select("id", "order", "chapter_index"), planned)


@query("""
WITH f AS (SELECT user_id AS book, event_id AS "order", CAST(length(event_type) % 2 AS INTEGER) AS chapter_index, floor(value) + 0.5 AS len FROM events),
c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY book ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start, sum(len) OVER (PARTITION BY book) AS total,
  lag(chapter_index) OVER (PARTITION BY book ORDER BY "order") AS before FROM f),
m AS (SELECT * FROM c WHERE before IS NULL OR before <> chapter_index)
SELECT book, "order", chapter_index, start, coalesce(lead(start) OVER (PARTITION BY book ORDER BY "order"), total) AS "end" FROM m
""")
def chapter_marks(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("order"), (F.length("event_type") % 2).alias("chapter_index"), F.floor("value").cast("double").alias("duration_sec"), F.lit(500).alias("pause_after_ms"))
    return windows.chapter_marks(rows)


@query("""
SELECT user_id AS voice, event_id AS id FROM (
  SELECT *, row_number() OVER w - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY user_id) // 12) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE pos % step = 0 AND pos < step * 12
""")
def stride_sample(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("voice"), F.col("event_id").alias("id"), F.col("event_id").alias("order"))
    return windows.stride_sample(rows, "voice", "order").select("voice", "id")


@query("""
SELECT user_id AS voice, bool_and(value <= 45) AS all_silent FROM (
  SELECT *, row_number() OVER w - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY user_id) // 12) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE pos % step = 0 AND pos < step * 12 GROUP BY user_id
""")
def all_silent(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("voice"), F.col("event_id").alias("order"), (F.col("value") - 105.0).alias("peak_dbfs"))
    return windows.all_silent(rows, "voice", "order")


@query("""
SELECT user_id AS voice, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) WHERE pos % 7 = 0 AND pos < 35
""")
def every_nth(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("voice"), F.col("event_id").alias("id"), F.col("event_id").alias("order"))
    return windows.every_nth(rows, "voice", "order", 7, 5).select("voice", "id")


@query("""
SELECT l_suppkey AS voice, arg_max(l_orderkey || '_' || l_linenumber, (l_extendedprice, -l_orderkey, -l_linenumber)) AS id FROM lineitem GROUP BY 1
""")
def reference_clips(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("voice"), F.format_string("%d_%d", "l_orderkey", "l_linenumber").alias("id"), F.col("l_extendedprice").alias("bytes"), F.struct("l_orderkey", "l_linenumber").alias("path"))
    return windows.reference_clip(rows, "voice").select("voice", "id")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 0.0 ELSE 1.0 END AS wer FROM conversations")
def wer_of_copies(spark, d):
    """Even turns against themselves with signs around: no edits; odd ones against silence: all words."""
    heard = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("- "), F.col("text"), F.lit(" ...!"))).otherwise(" ?")
    return load(spark, d, "conversations").select("conv_id", "turn", quality.word_error_rate(F.col("text"), heard).alias("wer"))


def _wer(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = load(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("heard"), before.alias("expected"))
    return turns.filter("expected IS NOT NULL").withColumn("wer", quality.word_error_rate(F.col("expected"), F.col("heard")))


@query()  # no SQL: DuckDB's edit distance is of bytes; tests hold whole turns to brute force
def wer(spark, d):
    return _wer(spark, d).select("conv_id", "turn", "wer")


@query("""
SELECT l_orderkey AS book, count(*) AS checked, round(avg(w), 4) AS mean_wer, CAST(count(*) FILTER (WHERE w > CASE lang WHEN 'pl' THEN 0.18 WHEN 'en' THEN 0.12 ELSE 0.15 END) AS BIGINT) AS flagged, CAST(count(*) FILTER (WHERE missing) AS BIGINT) AS missing, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages,
  count(*) FILTER (WHERE w > CASE lang WHEN 'pl' THEN 0.18 WHEN 'en' THEN 0.12 ELSE 0.15 END) = 0 AS ok, true AS "full"
FROM (SELECT l_orderkey, l_quantity % 10 = 0 AS missing, CASE WHEN l_quantity % 10 = 0 THEN 1.0 ELSE l_discount * 2 END AS w, CASE l_returnflag WHEN 'A' THEN 'pl' WHEN 'N' THEN 'en' ELSE 'de' END AS lang FROM lineitem) GROUP BY 1
""")
def qa_report(spark, d):
    language = F.when(F.col("l_returnflag") == "A", "pl").when(F.col("l_returnflag") == "N", "en").otherwise("de")
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), language.alias("language"), (F.col("l_discount") * 2).alias("wer"), (F.col("l_quantity") % 10 == 0).alias("missing"))
    return reports.qa_report(rows, "book")


@query("""
SELECT l_orderkey AS book, substr(sha256('[' || string_agg('["' || id || '", "' || fp || '"]', ', ' ORDER BY id, fp) || ']'), 1, 32) AS digest
FROM (SELECT l_orderkey, l_orderkey || '_' || l_linenumber AS id, CASE WHEN l_tax = 0 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS fp FROM lineitem) GROUP BY 1
""")
def audio_digest(spark, d):
    rows = _lines(spark, d, F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("int").cast("string")).alias("fingerprint"))
    return reports.audio_digest(rows, "book")


@query("""
SELECT l_shipmode AS model, l_returnflag AS category, count(*) AS total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS generated, round(avg(l_tax) FILTER (WHERE ok AND l_tax > 0), 2) AS realtime,
  CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE ok AND (l_quantity < 3 OR l_discount = 0)) AS BIGINT) AS odd FROM (SELECT *, l_linestatus AS l_shipmode, l_quantity % 9 <> 0 AS ok FROM lineitem) GROUP BY 1, 2
""")
def benchmark_report(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("category"), (F.col("l_quantity") % 9 != 0).alias("ok"), F.col("l_tax").alias("realtime"), (F.col("l_quantity") < 3).alias("silent"), (F.col("l_discount") == 0).alias("short"))
    return reports.benchmark_report(rows)


@query("""
SELECT * FROM (SELECT l_linestatus AS model, l_orderkey AS passage, l_linenumber AS repeat, CAST(row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber) AS INTEGER) AS rank FROM lineitem WHERE l_quantity % 9 = 0) WHERE rank <= 3
""")
def first_failures(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_linestatus").alias("model"), F.col("l_orderkey").alias("passage"), F.col("l_linenumber").alias("repeat"), (F.col("l_quantity") % 9 != 0).alias("ok"))
    return reports.first_failures(rows).select("model", "passage", "repeat", "rank")


@query("""
SELECT p_partkey AS key, CASE WHEN lufs <= -70 THEN NULL ELSE greatest(-12, least(12, CASE WHEN -20 - lufs > 0 THEN least(-20 - lufs, -3 - dbtp) ELSE -20 - lufs END)) END AS gain
FROM (SELECT p_partkey, CAST(-(p_size + 22) AS DOUBLE) AS lufs, -(p_size % 15) - 0.5 AS dbtp FROM part)
""")
def gain(spark, d):
    size = F.col("p_size")
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), quality.gain_for(-(size + 22).cast("double"), -(size % 15) - F.lit(0.5)).alias("gain"))


@query("""
SELECT p_partkey AS key, concat_ws(',', CASE WHEN p_size < 20 THEN 'too short' WHEN p_size * 4 < 120 THEN 'short' END, CASE WHEN p_size % 7 = 0 THEN 'no level' WHEN p_size % 7 = 1 THEN 'silent' WHEN p_size % 7 = 2 THEN 'clipped' END,
  CASE WHEN p_size % 10 >= 6 THEN 'mostly silence' END, CASE WHEN p_size % 2 = 0 THEN 'several channels' END) AS findings FROM part
""")
def recording_findings(spark, d):
    size = F.col("p_size")
    peak = F.when(size % 7 == 1, -55.0).when(size % 7 == 2, -0.1).when(size % 7 > 2, -9.0)
    found = quality.recording_findings(F.when(size < 20, size).otherwise(size * 4).cast("double"), peak, (size % 10) / 10, 1 + (size + 1) % 2)
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.array_join(found, ",").alias("findings"))


@query("""
SELECT l_orderkey AS book, count(*) AS total, CAST(count(*) FILTER (WHERE o = 'rendered') AS BIGINT) AS rendered, CAST(count(*) FILTER (WHERE o = 'skipped') AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE o = 'failed') AS BIGINT) AS failed,
  sum(l_quantity) AS audio_sec, sum(l_quantity * 2) AS elapsed_sec, count(*) FILTER (WHERE o = 'failed') = 0 AS ok, round(sum(l_quantity) / sum(l_quantity * 2), 2) AS realtime
FROM (SELECT *, CASE CAST(l_quantity AS INTEGER) % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'rendered' END AS o FROM lineitem) GROUP BY 1
""")
def render_report(spark, d):
    q = F.col("l_quantity").cast("int") % 6
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.when(q == 0, "failed").when(q == 1, "skipped").otherwise("rendered").alias("outcome"), F.col("l_quantity").alias("audio_sec"), (F.col("l_quantity") * 2).alias("elapsed_sec"))
    return reports.render_report(rows, "book")


@query("""
SELECT o_orderkey AS id, CASE WHEN t = 0 THEN 0.0 ELSE round_even(100.0 * n / t, 1) END AS percent, CASE WHEN n > 0 AND t > n THEN round_even((t - n) * (64.0 / n), 1) ELSE 0.0 END AS eta
FROM (SELECT o_orderkey, o_orderkey % 16 AS t, (o_orderkey % 16) // 2 AS n FROM orders)
""")
def progress(spark, d):
    total = F.col("o_orderkey") % 16
    done = F.floor(total / 2)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), reports.percent(done, total).alias("percent"), reports.eta_seconds(total, done, done, F.lit(64.0)).alias("eta"))


@query("""
SELECT l_orderkey AS book, sum(s) AS total_seconds, coalesce(sum(s) FILTER (WHERE l_linenumber > 2), 0.0) AS remaining_seconds,
  CAST(floor(coalesce(sum(s) FILTER (WHERE l_linenumber > 2), 0.0) * 24000 * 2 * 1.25) AS BIGINT) AS synthesis_bytes, CAST(floor(sum(s) * 8000 * 1.25) AS BIGINT) AS assembly_bytes
FROM (SELECT *, l_quantity AS s FROM lineitem) GROUP BY 1
""")
def disk_estimate(spark, d):
    rows = _lines(spark, d, F.col("l_quantity").alias("est_seconds"))
    return reports.disk_estimate(rows, rows.filter("order <= 2"), "book")


@query("""
SELECT l_suppkey AS voice, count(*) AS segments, round(sum(l_quantity) / 60, 2) AS minutes FROM lineitem WHERE l_quantity BETWEEN 1.5 AND 15 AND l_linenumber <> 4 GROUP BY 1
""")
def dataset_totals(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("voice"), F.col("l_quantity").alias("seconds"), F.when(F.col("l_linenumber") == 4, "short").otherwise("long enough").alias("text"))
    return reports.dataset_totals(rows, "voice")


@query("""
SELECT voice, id, rank FROM (SELECT l_suppkey AS voice, l_orderkey || '_' || l_linenumber AS id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey || '_' || l_linenumber) AS INTEGER) AS rank FROM lineitem WHERE l_quantity BETWEEN 1.5 AND 15) WHERE rank <= 12
""")
def dataset_references(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("voice"), F.format_string("%d_%d", "l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").alias("seconds"), F.lit("long enough").alias("text"))
    return reports.dataset_references(rows, "voice").select("voice", "id", "rank")


@query("""
SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 3 <> 0) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def orphans(spark, d):
    assets = load(spark, d, "part").select(F.col("p_partkey").alias("key"))
    used = load(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).alias("ref"))
    return checks.unreferenced(assets, "key", [F.col("ref"), F.col("s_suppkey")], [used, load(spark, d, "supplier")])


@query("""
SELECT count(*) AS assets, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS bytes_freed FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 3 <> 0)
""")
def sweep(spark, d):
    assets = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("size"))
    used = load(spark, d, "lineitem").filter("l_partkey % 3 <> 0")
    return catalog.sweep(assets, checks.unreferenced(assets.select("key"), "key", [F.col("l_partkey")], [used]), "key", "size")


@query("SELECT c_custkey, c_nationkey + 20 AS nation FROM customer WHERE c_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def foreign_keys(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") + 20).alias("nation"))
    return catalog.foreign_key_problems(rows, load(spark, d, "nation"), "nation", "n_nationkey").select("c_custkey", "nation")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def insert_or_ignore(spark, d):
    rows = load(spark, d, "supplier").select("s_suppkey", "s_name")
    return catalog.insert_or_ignore(rows.filter("s_suppkey % 3 <> 0"), rows.unionByName(rows), ["s_suppkey"], ["s_name"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return catalog.upsert(rows, rows.filter("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("SELECT o_orderkey AS id, o_custkey AS \"order\", CASE WHEN o_orderkey % 5 = 2 THEN 0.0 ELSE o_totalprice END AS duration FROM orders WHERE o_orderkey % 5 <> 4 OR o_custkey % 2 = 0")
def partial_merge(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("order"), F.col("o_totalprice").alias("duration"))
    rendered = rows.filter("id % 5 = 2").withColumn("duration", F.lit(0.0)).unionByName(rows.filter("id % 5 = 4 AND order % 2 = 0"))
    return catalog.merge_partial(rows.filter("id % 5 <> 4"), rendered, "id", "order")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS fingerprint FROM events GROUP BY 1")
def ledger_latest(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("fingerprint"), F.col("event_id").alias("line"))
    return checks.latest_by_line(rows, "id", "fingerprint", "line")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 5 = 0 OR o_orderstatus = 'O'")
def forget_runs(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"), "o_orderstatus")
    runs = rows.filter("run_id % 5 <> 0").select("id", F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    return catalog.forget({"items": rows}, runs, "id")["items"].select("id")


@query("""
SELECT vec_id, len(embedding) / 16000.0 AS seconds, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) AS peak, len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE) * power(10.0, 0.6)) > 1)) AS clipped, true AS held, true AS silent FROM embeddings
""")
def audio_samples(spark, d):
    """Vectors as samples: length, peak, what a gain of 12 dB clips, that nothing stays over full scale, and silence by length."""
    samples = F.col("embedding")
    loud = quality.apply_gain(samples, F.lit(12.0))
    return load(spark, d, "embeddings").select("vec_id", quality.duration(samples, 16000).alias("seconds"), quality.peak(samples).alias("peak"), loud["clipped"].cast("long").alias("clipped"), F.forall(loud["samples"], lambda x: F.abs(x) <= 1).alias("held"), quality.is_silent(samples, 16000).alias("silent"))


@query("SELECT doc_id, n_chars > 0 AND n_chars / 25.0 < n_chars / 14.0 * 0.55 AS flagged, CASE WHEN n_chars % 3 = 0 THEN 'voice' WHEN n_chars % 3 = 1 THEN 'model' ELSE 'fragment' END AS kind FROM documents")
def failure_flags(spark, d):
    n = F.col("n_chars")
    message = F.when(n % 3 == 0, "No latent file").when(n % 3 == 1, "CUDA out of memory").otherwise("assertion failed")
    return load(spark, d, "documents").select("doc_id", quality.looks_truncated(n, n / 25.0).alias("flagged"), quality.failure_kind(F.lit("RuntimeError"), message).alias("kind"))


@query("""
SELECT doc_id, CASE WHEN quality IS NULL THEN '' WHEN toxic = 1 THEN 'unknown' WHEN quality = 1 THEN 'full' ELSE 'sampled' END AS coverage, coalesce(quality = 1 AND n_chars % 2 = 0, false) AS stale FROM documents LEFT JOIN labels USING (doc_id)
""")
def qa_freshness(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    checked = F.when(F.col("quality") == 1, F.lit("a"))
    return rows.select("doc_id", quality.coverage_word(F.when(F.col("quality").isNotNull(), 1 - F.col("toxic")), F.col("quality") == 1).alias("coverage"), quality.qa_is_stale(checked, F.when(F.col("n_chars") % 2 == 0, "b").otherwise("a")).alias("stale"))


@query("""
WITH f AS (SELECT l_suppkey AS voice, l_orderkey || '_' || l_linenumber AS id, l_partkey, l_discount AS wer FROM lineitem)
SELECT f.id, f.wer, p_brand AS role, p_brand IS NOT NULL AND p_size > 10 AS has_audio FROM f LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) p ON p.p_partkey = f.l_partkey
""")
def findings_page(spark, d):
    findings = load(spark, d, "lineitem").select(F.format_string("%d_%d", "l_orderkey", "l_linenumber").alias("fragment"), F.col("l_partkey").alias("id"), F.col("l_discount").alias("wer"))
    chunks = load(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("role"), F.when(F.col("p_size") > 10, "x").alias("audio_path"))
    return catalog.findings_page(findings, chunks).select(F.col("fragment").alias("id"), "wer", "role", "has_audio")


@query("SELECT l_orderkey || '_' || l_linenumber AS id, p_name AS text, s_name AS sha256 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def run_fragments(spark, d):
    fragments = load(spark, d, "lineitem").select(F.format_string("%d_%d", "l_orderkey", "l_linenumber").alias("id"), F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("asset_id"))
    chunks = load(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"))
    assets = load(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("sha256"))
    return catalog.run_fragments(fragments, chunks, assets).select("id", "text", "sha256")


@query("SELECT o_orderkey AS id FROM orders")
def verified_results(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("voice"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("fingerprint"))
    done = checks.verified_results(rows, rows)
    return done.select(F.col("id").cast("long").alias("id"))
