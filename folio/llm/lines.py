r"""Line dedup by site-relative frequency (operator 2).

Pages are grouped by host. A line's frequency at a site is the number of the host's pages that contain it over
the number of the host's pages; lines above `ratio` are boilerplate and are dropped from every page of that host.
A line of one page alone stays (`min_pages` = 2): on a host of one page every line has the frequency 1, and the
page would lose its whole text. Lines are the page's text between block tags, trimmed, without scripts,
styles, comments and other tags; empty lines do not count.

Each page contributes a line once, counts are summed before they are dealt, and a host's boilerplate holds at
most (mean lines of its pages) / ratio lines, so it stays one row per host however many pages the host has. Hosts of
many pages are not dealt by host before that: their totals, a bounded number of rows, are broadcast.

Defined results: a url without a host, or a null url, belongs to the host of empty name; null html has no lines
and an empty text; of repeated rows each counts as a page; an empty table gives no rows; extra columns are
ignored; a page whose lines all go keeps an empty text; a null page_id is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>|<!--.*?-->"
BLOCK = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)([\x20\x09-\x0D/][^>]*)?>"
TAG = r"<[^>]*>"
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"

#: Rows of hosts' boilerplate up to which it is broadcast, some 20 bytes each; beyond, a salted shuffle join.
BROADCAST_LINES = 500_000
SALTS = 64


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, EDGE, "")), lambda x: x != "")


def line_key(line: Column) -> Column:
    """96 bits that stand for the line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.5, min_pages: int = 2) -> DataFrame:
    """Each page of pages (page_id, url, html): page_id, host, n_lines, n_dropped, text."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    rows = common.materialize(rows, "lines")
    totals = common.materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "totals")
    bound = common.hub_bound(totals.agg(F.sum("pages")).first()[0] or 0)
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    frequent = common.hub_join(counts, totals, "host", "pages", bound).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    boilerplate = common.materialize(frequent.groupBy("host").agg(F.collect_set("line").alias("common")), "boilerplate")
    size = boilerplate.agg(F.sum(F.size("common"))).first()[0] or 0
    if size <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(boilerplate), "host", "left")
    else:
        salted = boilerplate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("common"), line_key(x)), F.lit(False)))
    out = joined.select("page_id", "host", "lines", kept.alias("kept"))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(common.table(spark, sf_dir, "pages"))


ORACLE = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
           lambda x: regexp_replace(x, '{EDGE}', '', 'g')), lambda x: x <> '') AS lines
  FROM pages
), e AS (
  SELECT r, page_id, host, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM p
), b AS (
  SELECT host, line, count(DISTINCT r) AS n FROM e GROUP BY host, line
), t AS (
  SELECT host, count(*) AS pages FROM p GROUP BY host
), f AS (
  SELECT b.host, b.line FROM b JOIN t ON b.host = t.host WHERE n >= 2 AND n > 0.5 * pages
), k AS (
  SELECT e.r, string_agg(e.line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM e LEFT JOIN f ON e.host = f.host AND e.line = f.line WHERE f.line IS NULL GROUP BY e.r
)
SELECT p.page_id, p.host, CAST(len(p.lines) AS BIGINT) AS n_lines, CAST(len(p.lines) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, coalesce(k.text, '') AS text
FROM p LEFT JOIN k ON p.r = k.r
"""
