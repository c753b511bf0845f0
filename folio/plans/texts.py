"""Queries of the text and identity functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import decoding, identity
from folio.functions import text as tx
from folio.io import load
from folio.operators import checks
from folio.plans.registry import query

#: TX-02 in DuckDB: its expressions have no look-ahead, so a footnote in round brackets keeps what follows it.
NORMALISE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(
  regexp_replace(replace({0}, chr(173), ''), '([\p{L}\p{M}\p{N}_])-[ \t]*\r?\n[ \t]*([\p{L}\p{M}\p{N}_])', '\1\2', 'g'),
  '[“-‟]', '"', 'g'), '[‘-‛]', '''', 'g'), '…', '...'), '[—–]', ' - ', 'g'),
  '\[\d{1,3}\]|\{\d{1,3}\}', '', 'g'), '\(\d{1,3}\)(\s|$)', '\1', 'g'), '\s+', ' ', 'g'))"""


def normalise_sql(column: str) -> str:
    return NORMALISE.replace("{0}", column)


PARAGRAPHS = rf"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, paragraph FROM (
  SELECT doc_id, pos, {normalise_sql("block")} AS paragraph FROM (
    SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS block, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS pos FROM documents
  )
) WHERE length(paragraph) > 1
"""


@query(PARAGRAPHS)
def paragraphs(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def word_counts(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query(r"""
SELECT p_partkey AS key, CASE WHEN s = '' THEN 'book' ELSE s END AS slug FROM (
  SELECT p_partkey, regexp_replace(lower(trim(regexp_replace(strip_accents(p_name), '[^\w\s-]', '', 'g'))), '[-\s]+', '-', 'g') AS s FROM part)
""")
def slugs(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), tx.slugify(F.col("p_name")).alias("slug"))


@query(rf"""
SELECT doc_id, CASE WHEN n = 0 THEN 0.0 WHEN letters = 0 THEN -penalty
  ELSE expected / letters - 4.0 * ((letters - expected) / letters) - penalty END AS quality FROM (
  SELECT doc_id, length(text) AS n, CAST(length(regexp_replace(text, '\P{{L}}', '', 'g')) AS DOUBLE) AS letters,
    length(regexp_replace(text, '[^A-Za-z{tx.POLISH_LETTERS}]', '', 'g')) AS expected,
    (50.0 * length(regexp_replace(text, '[^\x{{80}}-\x{{9f}}]', '', 'g')) + 100.0 * length(regexp_replace(text, '[^�]', '', 'g'))
      + 20.0 * length(regexp_replace(text, '[\x00-\x7f\x{{80}}-\x{{9f}}�{tx.POLISH_LETTERS}{tx.LOAN_LETTERS}{tx.PROSE_SIGNS}]', '', 'g'))) / length(text) AS penalty
  FROM documents)
""")
def text_quality(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.text_quality(F.col("text")).alias("quality"))


#: Byte-order marks before texts, by doc_id modulo 6.
MARKS = {1: "efbbbf", 2: "fffe", 3: "feff", 4: "fffe0000", 5: "0000feff"}


@query("""
SELECT doc_id, sha256(raw) AS sha256, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' WHEN 3 THEN 'utf-16' ELSE 'utf-32' END AS bom, octet_length(raw) AS bytes
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ''::BLOB WHEN 1 THEN unhex('efbbbf') WHEN 2 THEN unhex('fffe') WHEN 3 THEN unhex('feff') WHEN 4 THEN unhex('fffe0000') ELSE unhex('0000feff') END || encode('x' || text) AS raw FROM documents)
""")
def utf8_bom_check(spark, d):
    mark = F.coalesce(*(F.when(F.col("doc_id") % 6 == k, F.unhex(F.lit(m))) for k, m in MARKS.items()), F.lit(b""))
    raw = F.concat(mark, F.concat(F.lit("x"), F.col("text")).cast("binary"))
    return load(spark, d, "documents").select("doc_id", tx.sha256(raw).alias("sha256"), tx.bom_encoding(raw).alias("bom"), F.octet_length(raw).cast("long").alias("bytes"))


@query("SELECT doc_id, text, 'utf-8' AS encoding, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'utf-8' ELSE 'ascii' END AS method, false AS needs_review FROM (SELECT doc_id, nfc_normalize(text) AS text FROM documents)".replace("\\\\", "\\"))
def decode_utf8(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return decoding.decode(docs).select("doc_id", "decoded.text", "decoded.encoding", "decoded.method", "decoded.needs_review")


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), k AS (SELECT h, min('a' || doc_id) AS same_slug FROM d WHERE doc_id % 10 = 3 GROUP BY h),
w AS (SELECT doc_id, count(*) OVER (PARTITION BY d.h) AS copies, min(doc_id) OVER (PARTITION BY d.h) AS first, same_slug, CASE WHEN doc_id % 10 = 4 THEN 'b' || doc_id END AS path_slug FROM d LEFT JOIN k ON k.h = d.h)
SELECT doc_id, copies, CASE WHEN same_slug IS NOT NULL THEN 'unchanged' WHEN first < doc_id THEN 'duplicate' WHEN path_slug IS NOT NULL THEN 'revised' ELSE 'new' END AS status,
  coalesce(same_slug, CASE WHEN first = doc_id THEN path_slug END, 'book') AS slug, CASE WHEN same_slug IS NULL AND first < doc_id THEN first ELSE -1 END AS duplicate_of FROM w
""")
def content_duplicates(spark, d):
    """A scan of all documents, of which a tenth are known by their bytes and a tenth by their path with other bytes."""
    from pyspark.sql import Window

    files = load(spark, d, "documents").select(F.format_string("%018d", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.lit("book").alias("slug"), "doc_id")
    same = files.filter("doc_id % 10 = 3").select(F.format_string("a%d", "doc_id").alias("slug"), "sha256", F.lit("").alias("source"))
    moved = files.filter("doc_id % 10 = 4").select(F.format_string("b%d", "doc_id").alias("slug"), F.lit("x").alias("sha256"), F.col("path").alias("source"))
    found = checks.classify_sources(files.drop("doc_id"), same.unionByName(moved))
    copies = F.count(F.lit(1)).over(Window.partitionBy("sha256"))
    return found.select(F.col("path").cast("long").alias("doc_id"), copies.alias("copies"), "status", "slug", F.coalesce(F.col("duplicate_of").cast("long"), F.lit(-1)).alias("duplicate_of"))


@query("SELECT DISTINCT lang, lower(lang) AS code FROM documents")
def language_codes(spark, d):
    rows = load(spark, d, "documents").select("lang").distinct()
    return rows.select("lang", tx.language_code(F.concat("lang", F.lit("_XX"))).alias("code"))


@query(r"""
SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(nfkc), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS tokens FROM (SELECT conv_id, turn, text AS nfkc FROM conversations)
""")
def comparison_tokens(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", tx.comparison_tokens(F.col("text")).alias("tokens"))


@query("""
SELECT o_orderkey AS id, printf('%02d:%02d:%02d.%03d', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60, CAST(floor((t - s) * 1000) AS BIGINT)) AS clock,
  CASE WHEN s >= 3600 THEN printf('%dh %02dm', s // 3600, (s % 3600) // 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration,
  CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size
FROM (SELECT o_orderkey, o_totalprice AS t, CAST(floor(o_totalprice) AS BIGINT) AS s, o_totalprice * 50 AS b FROM orders)
""")
def formatted_labels(spark, d):
    price = F.col("o_totalprice")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tx.timestamp_label(price).alias("clock"), tx.duration_label(price).alias("duration"), tx.size_label(price * 50).alias("size"))


@query(r"""
SELECT item_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([=;#\\\n])', '\\\1', 'g') AS escaped,
  'file ''' || replace(text, '''', '''\''''') || '''' AS line, regexp_matches(text, '^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$') AS safe FROM benchmark
""")
def escapes(spark, d):
    text = F.col("text")
    return load(spark, d, "benchmark").select("item_id", tx.metadata_value(text).alias("escaped"), tx.concat_line(text).alias("line"), tx.is_safe_name(text).alias("safe"))


@query("""
SELECT item_id, CASE WHEN l > 0 THEN '…' ELSE '' END || trim(substr(text, l + 1, r - l)) || CASE WHEN r < length(text) THEN '…' ELSE '' END AS excerpt FROM (
  SELECT item_id, text, greatest(40 - 40, 0) AS l, least(50 + 40, length(text)) AS r FROM benchmark)
""")
def excerpts(spark, d):
    return load(spark, d, "benchmark").select("item_id", tx.excerpt(F.col("text"), F.lit(40), F.lit(50)).alias("excerpt"))


@query("""
SELECT p_partkey AS key, CAST(CASE p_size % 4 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1000000 WHEN 2 THEN p_size ELSE 64000 END AS BIGINT) AS bits FROM part
""")
def bitrates(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(size, F.lit("k"))).when(F.col("p_size") % 4 == 1, F.concat(size, F.lit("M "))).when(F.col("p_size") % 4 == 2, size).otherwise("fast")
    return load(spark, d, "part").select(F.col("p_partkey").alias("key"), tx.parse_bitrate(text).alias("bits"))


@query(r"""
SELECT page_id, regexp_matches(regexp_extract(url, '^[^?#]*', 0), '(?i)(^|/)(nav|toc|contents|ncx)\.x?html?$') AS is_nav FROM pages
""")
def nav_pages(spark, d):
    from folio.sources.books import is_navigation

    path = F.regexp_extract("url", r"^[^?#]*", 0)
    return load(spark, d, "pages").select("page_id", is_navigation(path, F.array().cast("array<string>")).alias("is_nav"))


@query()
def html_paragraphs(spark, d):
    from folio.sources.books import html_paragraphs as paragraphs_of

    return load(spark, d, "pages").select("page_id", F.posexplode(paragraphs_of(F.col("html"))).alias("pos", "paragraph"))


@query("""
SELECT doc_id, substr(sha256('{"language":' || to_json(lang) || ',"model":"m@r1","renderer":1,"settings":{"speed":1.0,"temperature":0.7},"text":' || to_json(t)
  || ',"voice":' || to_json(source) || ',"voice_revision":""}'), 1, 32) AS fingerprint FROM (SELECT doc_id, lang, source, text AS t FROM documents)
""")
def fingerprints(spark, d):
    settings = F.create_map(F.lit("temperature"), F.lit(0.7), F.lit("speed"), F.lit(1.0))
    model = identity.model_identity(F.lit("m"), F.lit("r1"))
    return load(spark, d, "documents").select("doc_id", identity.fragment_fingerprint(F.col("text"), F.col("lang"), model, F.col("source"), F.lit(""), settings).alias("fingerprint"))


@query("""
SELECT vec_id, substr(sha256(CAST('profile' AS BLOB) || CAST(CAST(vec_id AS VARCHAR) AS BLOB) || CAST('latents' AS BLOB) || CAST(CAST(label AS VARCHAR) AS BLOB)), 1, 32) AS revision,
  substr(sha256(CAST('xtts' || CAST(vec_id AS VARCHAR) || CAST(label AS VARCHAR) AS BLOB)), 1, 32) AS conditioning FROM embeddings
""")
def voice_revisions(spark, d):
    raw = lambda c: F.col(c).cast("string").cast("binary")
    files = F.array(F.struct(F.lit("profile").alias("name"), raw("vec_id").alias("content")), F.struct(F.lit("latents").alias("name"), raw("label").alias("content")))
    return load(spark, d, "embeddings").select("vec_id", identity.voice_revision(files).alias("revision"), identity.conditioning_key(F.lit("xtts"), F.col("vec_id").cast("string"), raw("label")).alias("conditioning"))


_NUL = r"'\x00'::BLOB"


@query(f"SELECT doc_id, substr(sha256({' || '.join(f'encode({p}) || {_NUL}' for p in ('text', 'lang', 'source', chr(39) + 'r' + chr(39), chr(39) + 'm' + chr(39), chr(39) + '{"speed": 1.0}' + chr(39)))}), 1, 12) AS key FROM documents")
def audition_keys(spark, d):
    settings = F.create_map(F.lit("speed"), F.lit(1.0))
    return load(spark, d, "documents").select("doc_id", identity.audition_key(F.col("text"), F.col("lang"), F.col("source"), F.lit("r"), F.lit("m"), settings).alias("key"))
