"""Queries of the book operators: language, chunking, roles, speech, catalog views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.io import load
from folio.operators import catalog, checks, chunking, language, queueing, roles, sets, speech, windows
from folio.plans.registry import query
from folio.plans.texts import PARAGRAPHS, normalise_sql


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    """Documents as books of one file; lines of text are its paragraphs where it has no blank lines."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("book"), F.format_string("%d.txt", "doc_id").alias("name"), F.regexp_replace("text", "\n+", "\n\n").alias("text"))
    return chunking.chapters(docs)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    languages = load(spark, d, "documents").select(F.col("doc_id").alias("book"), F.col("lang").alias("language"))
    return chunking.chunk_plan(_chapters(spark, d), languages)


#: The plan in DuckDB: sentence ends marked the same way, and the same folds as list reductions.
_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(p, '([.!?…]["''»”)\]]*)\s+(["''«„“(\[]?[\p{Lu}\p{Nd}])', '\1' || chr(1) || '\2', 'g'),
  '(?i)(^|[^\p{L}\p{N}\p{M}_])(dr|mr|mrs|ms|prof|st|vs|np|inż|mgr|ul|św|ks|bd|vol|no|nr|ca|bzw|sog|mme|sra?)\.\x01', '\1\2. ', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""
_FOLD = "list_reduce(list_transform({0}, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[len(acc)]) + 1 + length(x[1]) <= {1} THEN list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || ' ' || x[1]]) ELSE list_concat(acc, x) END)"


_LINES = "(SELECT doc_id, regexp_replace(text, '\\n+', chr(10) || chr(10), 'g') AS text FROM documents)"
_PARTS = """flatten(list_transform(list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(s, '([;,])', '\\1' || chr(1), 'g'), chr(1)),
  lambda c: CASE WHEN length(c) <= lim THEN [c] ELSE string_split(c, ' ') END)), lambda w: trim(w)), lambda w: w <> ''), lambda w: list_transform(range((length(w) - 1) // lim + 1), lambda i: substr(w, i * lim + 1, lim))))"""


def _merge(runt: str) -> str:
    """A fold that joins a chunk to the one before it where `runt` says so and both fit."""
    return f"""list_reduce(list_transform({{0}}, lambda x: [x]), lambda acc, x: CASE WHEN {runt} AND length(acc[len(acc)]) + length(x[1]) + 1 <= lim
  THEN list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || ' ' || x[1]]) ELSE list_concat(acc, x) END)"""


PLAN = f"""
WITH p AS ({PARAGRAPHS.replace("FROM documents", "FROM " + _LINES)}),
l AS (SELECT p.doc_id, pos, lang, CASE lang WHEN 'en' THEN 250 WHEN 'es' THEN 239 WHEN 'fr' THEN 273 WHEN 'de' THEN 253 ELSE 250 END AS lim, {_SENTENCES.replace("p,", "paragraph,", 1)} AS sentences FROM p JOIN documents d ON d.doc_id = p.doc_id),
h AS (SELECT * EXCLUDE (sentences), flatten(list_transform(sentences, lambda s: CASE WHEN length(s) <= lim THEN [s] ELSE {_FOLD.format(_PARTS, "lim")} END)) AS pieces FROM l),
f AS (SELECT * EXCLUDE (pieces), {_FOLD.format("pieces", "lim")} AS chunks FROM h),
b AS (SELECT * EXCLUDE (chunks), {_merge("length(x[1]) < 40").format("chunks")} AS chunks FROM f),
m AS (SELECT * EXCLUDE (chunks), {_merge("len(acc) = 1 AND length(acc[1]) < 40").format("chunks")} AS chunks FROM b),
c AS (SELECT doc_id, lang, CAST(pos + 1 AS INTEGER) AS paragraph, 'paragraph' AS kind, unnest(chunks) AS text, generate_subscripts(chunks, 1) - 1 AS piece, len(chunks) AS n FROM m
  UNION ALL SELECT DISTINCT doc_id, lang, 0, 'heading', CAST(doc_id AS VARCHAR), 0, 1 FROM m),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, piece) - 1 AS INTEGER) AS "order" FROM c),
plan AS (SELECT doc_id AS book, printf('ch%03d_%04d', 1, "order") AS id, 1 AS chapter_index, CAST(doc_id AS VARCHAR) AS chapter_title, "order", paragraph, kind, lang AS language, text,
  CASE WHEN kind = 'heading' THEN 900 WHEN piece = n - 1 THEN 350 ELSE 120 END AS pause_after_ms, CAST(length(text) AS INTEGER) AS chars, round(length(text) / 15.0, 2) AS est_seconds FROM o)
"""


@query(PLAN + "SELECT * FROM plan")
def chunk_plan(spark, d):
    return _plan(spark, d)


@query(rf"""
WITH p AS ({PARAGRAPHS.replace("documents", "(SELECT doc_id, regexp_replace(text, '\\n+', chr(10) || chr(10), 'g') AS text FROM documents)").replace("'\\\\n+'", "'\\n+'")})
SELECT doc_id, pos, {_SENTENCES.replace("p,", "paragraph,", 1)} AS sentences FROM p
""")
def sentences(spark, d):
    rows = _chapters(spark, d).select(F.col("book").alias("doc_id"), F.posexplode("paragraphs").alias("pos", "p"))
    return rows.select("doc_id", "pos", chunking.sentences(F.col("p")).alias("sentences"))


@query(f"""
WITH w AS (SELECT doc_id, 60 AS lim, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, lim, flatten(list_transform(words, lambda s: CASE WHEN length(s) <= lim THEN [s] ELSE {_FOLD.format(_PARTS, "lim")} END)) AS pieces FROM w WHERE len(words) > 0)
SELECT doc_id, {_FOLD.format("pieces", "lim")} AS chunks FROM s
""")
def greedy_pack(spark, d):
    words = tx.words(F.col("text"))
    rows = load(spark, d, "documents").select("doc_id", words.alias("words")).filter(F.size("words") > 0)
    return rows.select("doc_id", chunking.pack(F.col("words"), F.lit(60), 0).alias("chunks"))


@query(PLAN + "SELECT DISTINCT book, true AS within_limit, true AS all_kept FROM plan")
def chunk_invariants(spark, d):
    """No chunk over its limit, and every character that is no blank kept: one row for each book, all true."""
    plan = _plan(spark, d).filter("kind = 'paragraph'")
    letters = lambda c: F.length(F.regexp_replace(c, r"(?U)\s", ""))
    made = plan.groupBy("book").agg(F.sum(letters("text")).alias("kept"), F.bool_and(F.col("chars") <= chunking.char_limit(F.col("language"))).alias("within_limit"))
    had = _chapters(spark, d).groupBy("book").agg(F.sum(F.aggregate("paragraphs", F.lit(0), lambda acc, p: acc + letters(p))).alias("had"))
    return made.join(had, "book").select("book", "within_limit", (F.col("kept") == F.col("had")).alias("all_kept"))


@query(PLAN + "SELECT book, chapter_index, min(\"order\") AS first_chunk, count(*) AS chunk_count FROM plan GROUP BY 1, 2")
def chapter_refs(spark, d):
    return chunking.chapter_refs(_plan(spark, d))


@query(PLAN + "SELECT book, round(sum(est_seconds) / 3600, 2) AS est_hours FROM plan GROUP BY 1")
def estimated_hours(spark, d):
    return chunking.estimated_hours(_plan(spark, d))


_OPENERS = "|".join(roles.OPENERS).replace("'", "''")


@query(PLAN + f"SELECT language, count(*) AS chunks, CAST(0 AS BIGINT) AS oversize, CAST(count(*) FILTER (WHERE kind = 'paragraph' AND regexp_matches(text, '^({_OPENERS})')) AS BIGINT) AS dialogue FROM plan GROUP BY 1")
def plan_counts(spark, d):
    return chunking.plan_counts(_plan(spark, d))


@query("SELECT lang, CASE lang WHEN 'en' THEN 250 WHEN 'es' THEN 239 WHEN 'fr' THEN 273 WHEN 'de' THEN 253 WHEN 'pl' THEN 224 ELSE 250 END AS char_limit FROM (SELECT DISTINCT lang FROM documents)")
def char_limits(spark, d):
    return load(spark, d, "documents").select("lang").distinct().select("lang", chunking.char_limit(F.col("lang")).alias("char_limit"))



def _hits(words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words.split(" "))
    return f"len(list_filter(tokens, lambda x: x IN ({listed})))"


@query(f"""
SELECT doc_id, CASE WHEN total = 0 THEN '' WHEN de = best THEN 'de' WHEN en = best THEN 'en' WHEN es = best THEN 'es' WHEN fr = best THEN 'fr' ELSE 'pl' END AS language,
  CASE WHEN total = 0 THEN 0.0 ELSE round(best / total, 4) END AS confidence FROM (
  SELECT *, pl + en + de + fr + es AS total, greatest(pl, en, de, fr, es) AS best FROM (
    SELECT doc_id, {", ".join(f"{_hits(w)} AS {c}" for c, w in language.FUNCTION_WORDS.items())} FROM (
      SELECT doc_id, string_split(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g')), ' ') AS tokens FROM documents)))
""")
def language_classify(spark, d):
    found = language.classify(F.col("text"))
    return load(spark, d, "documents").select("doc_id", found["language"].alias("language"), found["confidence"].alias("confidence"))


@query(rf"""
WITH p AS ({PARAGRAPHS}), b AS (
  SELECT doc_id, string_agg(paragraph, ' ' ORDER BY pos) FILTER (WHERE length(paragraph) > 40) AS body, string_agg(paragraph, ' ' ORDER BY pos) AS whole FROM p GROUP BY doc_id)
SELECT doc_id AS book, CASE WHEN length(coalesce(body, '')) >= 200 THEN doc_id || '.txt#0' ELSE 'whole book' END AS place,
  CASE WHEN length(coalesce(body, '')) >= 200 THEN substr(body, 1, 1000) ELSE whole END AS sample FROM b
""")
def language_samples(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("book"), F.format_string("%d.txt", "doc_id").alias("name"), "text")
    return language.gather_samples(chunking.chapters(docs))


@query("""
WITH s AS (SELECT source AS book, sum(n_chars) AS coverage, list_sort(list(DISTINCT d.lang) FILTER (WHERE c >= 0.65)) AS found, avg(c) FILTER (WHERE c >= 0.65) AS mean
  FROM (SELECT d.source, d.lang, least(d.n_chars, 1000) AS n_chars, CASE WHEN l.quality = 1 THEN 0.9 WHEN l.quality = 0 THEN 0.5 ELSE 0.7 END AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d GROUP BY source),
r AS (SELECT *, coalesce(len(found), 0) AS n, CASE WHEN coverage < 400 THEN 'too little text' WHEN coalesce(len(found), 0) = 0 THEN 'no clear passage' WHEN len(found) > 1 THEN 'passages disagree' WHEN found[1] NOT IN ('pl', 'en') THEN 'unsupported language' END AS reason FROM s)
SELECT book, CASE WHEN coverage >= 400 AND n = 1 THEN found[1] ELSE '' END AS language, CASE WHEN reason IS NULL THEN 'content' ELSE '' END AS method,
  CASE WHEN reason IS NULL THEN round(mean, 4) ELSE 0.0 END AS confidence, CAST(coverage AS BIGINT) AS coverage_chars, reason IS NOT NULL AS needs_review, coalesce(reason, '') AS reason,
  CASE WHEN coverage < 400 THEN 'metadata claims a language' WHEN reason IS NULL AND found[1] <> 'en' THEN 'metadata disagrees with text' ELSE '' END AS warning FROM r
""")
def language_decision(spark, d):
    labels = load(spark, d, "labels").select("doc_id", "quality")
    rows = load(spark, d, "documents").join(labels, "doc_id", "left")
    confidence = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.5).otherwise(0.7)
    samples = rows.select(F.col("source").alias("book"), F.least("n_chars", F.lit(1000)).alias("chars"), F.col("lang").alias("language"), confidence.alias("confidence"))
    books = rows.select(F.col("source").alias("book")).distinct().select("book", F.lit("en_GB").alias("metadata_language"), F.lit("").alias("override"))
    return language.decide(samples, books)


@query(rf"""
WITH p AS ({PARAGRAPHS})
SELECT doc_id, pos, CASE WHEN opens AND NOT tag THEN 'dialogue' ELSE 'narrator' END AS role, opens AND NOT tag AS is_dialogue FROM (
  SELECT doc_id, pos, regexp_matches(paragraph, '^({_OPENERS})') AS opens, length(paragraph) < 60 AND regexp_matches(paragraph, '(?i)(powiedzia\w+|said|asked|replied|whispered|shouted|muttered)') AS tag FROM p)
""")
def paragraph_roles(spark, d):
    docs = load(spark, d, "documents")
    rows = docs.select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    role = roles.assign_role(F.col("paragraph"), F.array(F.lit("narrator")))
    return rows.select("doc_id", "pos", role["role"].alias("role"), role["is_dialogue"].alias("is_dialogue"))


@query("""
SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'anna' WHEN 'system' THEN 'piotr' ELSE 'michal' END AS voice
FROM (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'system' ELSE role END AS role FROM conversations)
""")
def cast_resolution(spark, d):
    cast = spark.createDataFrame([("narrator", "michal"), ("user", "anna"), ("system", "piotr")], "role string, voice string")
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role")
    overrides = rows.filter("conv_id % 5 = 0 AND turn = 0").select("conv_id", "turn", F.lit("system").alias("role")).distinct()
    return roles.resolve_cast(roles.override_roles(rows, overrides, ["conv_id", "turn"]), cast).select("conv_id", "turn", "role", "voice")


@query("""
SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN 'speed=1.25,temperature=0.7' ELSE 'temperature=0.7' END AS settings, CASE WHEN p_size % 2 = 0 THEN 'emotion' ELSE '' END AS unsupported,
  CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_brand < 'v' THEN p_brand || ', v' ELSE 'v, ' || p_brand END AS narrator FROM part
""")
def role_settings(spark, d):
    size, controls = F.col("p_size"), F.array(F.lit("speed"), F.lit("temperature"))
    empty = F.create_map().cast("map<string,double>")
    wanted = F.when(size % 2 == 0, F.create_map(F.lit("emotion"), F.lit(0.5))).otherwise(empty)
    speed = roles.speed_setting(F.when(size % 3 == 0, 1.25).otherwise(1.0), controls)
    pinned = roles.pinned_settings(F.create_map(F.lit("temperature"), F.lit(0.7)), sets.map_union(wanted, speed), controls)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(pinned)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    cast = F.create_map(F.lit("narrator"), F.lit("v"), F.lit("user"), F.col("p_brand"), F.lit("system"), F.lit("v"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), shown.alias("settings"), F.array_join(roles.unsupported_controls(wanted, controls), ",").alias("unsupported"), roles.narrator_tag(F.when(size % 5 == 0, F.col("p_brand")), cast).alias("narrator"))


@query()  # no SQL: matches in order of place and length; tests hold whole texts to brute force
def symbol_rewrite(spark, d):
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("en").alias("language"), "text")
    return speech.prepare(rows).select("id", F.col("text").alias("spoken"), F.size("substitutions").cast("long").alias("changes"))


@query()  # no SQL, as above
def abbreviation_rewrite(spark, d):
    rows = load(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("en").alias("language"), F.concat(F.lit("Dr. Who met Mrs. Lee, e.g. "), F.col("text")).alias("text"))
    return speech.prepare(rows, {"Lee": "Lea"}).select("id", "text", "source_text", F.to_json("substitutions").alias("substitutions"))


@query("SELECT id, true AS spans_hold, true AS offsets_hold, true AS pieces_hold FROM (SELECT item_id AS id FROM benchmark)")
def offset_map(spark, d):
    """Every span is its text on both sides, maps back to its start, and pieces carry what lies inside them."""
    rows = load(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("en").alias("language"), F.concat(F.lit("Dr. Who paid 15% & left. "), F.col("text")).alias("text"))
    done = speech.prepare(rows)
    cut = lambda c, a, b: F.substring(c, a + 1, b - a)
    text, source = F.col("text"), F.col("source_text")
    spans = F.forall("substitutions", lambda s: (cut(source, s["start"], s["end"]) == s["source"]) & (cut(text, s["spoken_start"], s["spoken_end"]) == s["spoken"]))
    offsets = F.forall("substitutions", lambda s: (speech.source_offset(F.col("substitutions"), F.length(source), s["spoken_start"]) == s["start"]) & (speech.source_offset(F.col("substitutions"), F.length(source), s["spoken_end"]) == s["end"]))
    pieces = speech.split_provenance(text, source, F.col("substitutions"), F.split(text, r"(?<=[.]) "))
    held = F.forall(pieces, lambda p: F.forall(p["substitutions"], lambda s: (cut(p["source_text"], s["start"], s["end"]) == s["source"]) & (cut(p["text"], s["spoken_start"], s["spoken_end"]) == s["spoken"])))
    return done.select("id", spans.alias("spans_hold"), offsets.alias("offsets_hold"), held.alias("pieces_hold"))


@query(r"""
WITH e(written) AS (VALUES ('the'), ('of'), ('nothing like this')), n AS (
  SELECT e.written, len(list_filter(string_split_regex(d.text, '[^\p{L}\p{N}\p{M}_]+'), lambda x: x = e.written)) AS n FROM documents d, e)
SELECT written, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY written HAVING sum(n) > 0
""")
def dictionary_preview(spark, d):
    entries = spark.createDataFrame([("the", "thee"), ("of", "ov"), ("nothing like this", "x")], "written string, spoken string")
    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("order"), "text")
    return speech.preview(chunks, entries)[0]


@query("SELECT p_partkey AS key, CASE p_size % 4 WHEN 0 THEN 'written form is blank' WHEN 1 THEN 'both forms are the same' WHEN 2 THEN 'more than one line' END AS reason FROM part WHERE p_size % 4 <> 3")
def dictionary_problems(spark, d):
    size, name = F.col("p_size") % 4, F.col("p_name")
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(size == 0, "  ").otherwise(name).alias("written"), F.when(size == 1, name).when(size == 2, F.concat(name, F.lit("\nx"))).otherwise(F.concat(name, F.lit("x"))).alias("spoken"))
    return speech.dictionary_problems(rows).select("key", "reason")


@query("""
SELECT c_custkey AS slug, o.o_orderkey AS run_id, o.o_orderdate AS created_at FROM customer JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o.o_custkey = c_custkey AND rn = 1
""")
def newest_run(spark, d):
    books = load(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_custkey").alias("current_text_id"))
    runs = load(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("text_id"), F.col("o_orderdate").alias("created_at"))
    return catalog.newest_run(books, runs)


@query("SELECT c_custkey AS slug, c_nationkey AS current_text_id, n_name AS language FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = c_nationkey")
def books_with_text(spark, d):
    books = load(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_nationkey").alias("current_text_id"))
    texts = load(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("language"))
    return catalog.books_with_text(books, texts).select("slug", "current_text_id", "language")


@query("""
WITH m(id, validation, langs) AS (VALUES ('a', 'validated', ['en', 'de']), ('b', 'baseline', ['en', 'fr', 'es']), ('c', 'unvalidated', ['en', 'pl']))
SELECT l.lang AS language, id, validation, CAST(row_number() OVER (PARTITION BY l.lang ORDER BY CASE validation WHEN 'validated' THEN 0 WHEN 'baseline' THEN 1 ELSE 2 END, id) AS INTEGER) AS place
FROM (SELECT DISTINCT lang FROM documents) l JOIN m ON list_contains(langs, l.lang)
""")
def eligible_models(spark, d):
    models = spark.createDataFrame([("a", "validated", ["en", "de"]), ("b", "baseline", ["en", "fr", "es"]), ("c", "unvalidated", ["en", "pl"])], "id string, validation string, narration_languages array<string>")
    return catalog.eligible_models(models, load(spark, d, "documents").select(F.col("lang").alias("language")).distinct())


@query("SELECT doc_id AS id, lang AS language, CASE lang WHEN 'de' THEN 'a' ELSE 'b' END AS model FROM documents")
def resolved_models(spark, d):
    models = spark.createDataFrame([("a", ["de"]), ("b", ["en", "fr", "es"])], "id string, narration_languages array<string>")
    requests = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.when(F.col("lang") == "de", "a").alias("override"))
    return catalog.resolve_model(requests, models, "b").select("id", "language", "model")


@query("""
SELECT d.doc_id AS book, CASE WHEN d.n_chars % 7 = 0 THEN 'stale' WHEN d.n_chars % 5 = 0 THEN 'rendering' WHEN l.toxic = 1 THEN 'silence' WHEN l.quality = 0 THEN 'failed' WHEN d.n_chars % 3 = 0 THEN 'done' WHEN l.quality = 1 THEN 'rendered' ELSE 'prepared' END AS state,
  CASE WHEN d.lang = 'en' THEN '' ELSE 'no language' END || CASE WHEN d.n_chars % 2 = 0 THEN '' ELSE ',no voice' END AS blocking
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def book_state(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    n, toxic = F.col("n_chars"), F.coalesce("toxic", F.lit(0)) == 1
    running = (n % 7 == 0) | (n % 5 == 0)
    state = queueing.book_state(running, n % 7 == 0, toxic, F.col("quality") == 1, F.when(n % 3 == 0, 1).otherwise(0))
    empty = F.create_map().cast("map<string,string>")
    who = queueing.readers(F.when(n % 2 == 0, "anna"), empty, empty)
    problems = queueing.blocking_problems(F.lit(False), F.when(F.col("lang") == "en", "en"), who)
    shown = F.concat(F.when(F.array_contains(problems, "no language"), "no language").otherwise(""), F.when(F.array_contains(problems, "no voice"), ",no voice").otherwise(""))
    return rows.select(F.col("doc_id").alias("book"), state.alias("state"), shown.alias("blocking"))


@query("""
SELECT doc_id AS book, CASE WHEN n_chars % 4 = 0 THEN 'chunk,synth,assemble' WHEN n_chars % 4 = 1 THEN 'synth,assemble' WHEN n_chars % 4 = 2 THEN 'assemble' ELSE '' END AS outstanding,
  CASE WHEN n_chars % 4 = 0 THEN 'chunk,synth,assemble,verify' WHEN n_chars % 4 = 1 THEN 'synth,assemble,verify' WHEN n_chars % 4 = 2 THEN 'assemble,verify' ELSE 'verify' END AS steps FROM documents
""")
def step_closure(spark, d):
    n = F.col("n_chars") % 4
    needs = sets.outstanding_steps(F.when(n > 0, 1).otherwise(0), n > 1, F.lit(False), F.when(n > 2, 1).otherwise(0))
    steps = sets.steps_for(needs, F.array(F.lit("verify"), F.lit("unknown")))
    return load(spark, d, "documents").select(F.col("doc_id").alias("book"), F.array_join(needs, ",").alias("outstanding"), F.array_join(steps, ",").alias("steps"))


@query("""
WITH s AS (SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-book' END AS slug FROM documents)
SELECT doc_id, slug AS base, slug || CASE WHEN rn = 1 THEN '' ELSE '-' || rn END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS rn FROM s)
""")
def unique_slugs(spark, d):
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "").otherwise("-book"))
    return windows.unique_slugs(load(spark, d, "documents").select("doc_id", name.alias("base")), "base", "doc_id").select("doc_id", "base", "slug")


@query("""
SELECT source AS book, doc_id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM (
    SELECT *, max(CASE WHEN length(text) BETWEEN 120 AND 600 THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS has_one FROM documents) WHERE has_one = 0 OR length(text) BETWEEN 120 AND 600
  ) WHERE pos = n // 2
""")
def median_passage(spark, d):
    rows = load(spark, d, "documents").select(F.col("source").alias("book"), "doc_id", F.col("doc_id").alias("order"), "text")
    return windows.median_passage(rows).select("book", "doc_id", "text")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def page_window(spark, d):
    return windows.page(load(spark, d, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), "doc_id"], 25, 50)


@query("""
SELECT source, lang AS status, count(*) AS files FROM documents GROUP BY source, lang
""")
def import_tally(spark, d):
    from folio.operators.reports import import_tally as tally

    return tally(load(spark, d, "documents").select("source", F.col("lang").alias("status")), "source")


@query("SELECT CASE WHEN lang = 'de' THEN 'pl' ELSE lang END AS language, count(*) AS chunks FROM documents GROUP BY 1")
def language_groups(spark, d):
    from folio.operators.reports import language_groups as groups

    return groups(load(spark, d, "documents").select(F.when(F.col("lang") != "de", F.col("lang")).alias("language")))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS path, count(*) AS copies, max(strlen(text)) AS bytes FROM documents GROUP BY 1")
def content_addressed(spark, d):
    files = load(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("bytes"))
    return catalog.content_addressed(files)


@query("SELECT source AS id, min(doc_id) AS place FROM documents GROUP BY source")
def distinct_in_order(spark, d):
    rows = load(spark, d, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("place"))
    return checks.distinct_in_order(rows, "id", "place")
