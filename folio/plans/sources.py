"""Queries of the readers and sinks: what the tables hold is written in a stored form and read back."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import decoding
from folio.io import in_pieces, load, shared_path
from folio.plans.registry import query
from folio.plans.texts import PARAGRAPHS
from folio.sources import books, tables

#: Lines of documents as paragraphs, in composed form.
_LINES = PARAGRAPHS.replace("FROM documents", r"FROM (SELECT doc_id, regexp_replace(nfc_normalize(text), '\n+', chr(10) || chr(10), 'g') AS text FROM documents)")


def _page(doc_id: int, text: str) -> str:
    """A document as a page: hidden parts, a heading for most, and a paragraph for each line."""
    title = "" if doc_id % 7 == 0 else f"<h1>{'Index of' if doc_id % 5 == 0 else 'Doc'} <b>{doc_id}</b></h1>"
    lines = "".join(f"<p>{html.escape(line)}</p>\n" if k % 3 else f"<blockquote><p>{html.escape(line)}<sup>1</sup></p></blockquote>" for k, line in enumerate(text.split("\n")))
    return f"<html><head><title>no text</title><style>p {{}}</style></head><body>{title}<script>hidden()</script>{lines}<table><tr><td>hidden</td></tr></table></body></html>"


@F.arrow_udf(T.StringType())
def _pages(doc_id: pa.Array, text: pa.Array) -> pa.Array:
    def made(row: tuple) -> tuple[str, int]:
        page = _page(row[0].as_py(), row[1].as_py() or "")
        return page, len(page)

    return in_pieces(zip(doc_id, text), made, pa.string())


@query(_LINES)
def html_blocks(spark, d):
    """SC-05: pages made of all documents, read back as paragraphs."""
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(books.html_paragraphs(_pages("doc_id", F.coalesce("text", F.lit(""))))).alias("pos", "paragraph"))
    return rows.withColumn("paragraph", decoding.nfc("paragraph"))


def _archive(book: int, docs: list[tuple[int, str | None]]) -> bytes:
    """The documents of a book as an EPUB: a spine against their order that forgets every fourth, and a cover told in one of four ways."""
    out, ids = io.BytesIO(), sorted(k for k, _ in docs)
    item = lambda name, path, kind, more="": f'<item id="{name}" href="{path}" media-type="{kind}" {more}/>'
    manifest = "".join(item(f"d{k}", f"text/{k}.xhtml", "application/xhtml+xml") for k in ids)
    manifest += item("nav", "text/list.xhtml", "application/xhtml+xml", 'properties="nav"') + item("gone", "text/gone.xhtml", "application/xhtml+xml")
    manifest += item("a", "images/a.png", "image/png", 'properties="cover-image"' if book % 4 == 0 else "")
    manifest += item("c", "images/front.jpg" if book % 4 == 3 else "images/cover.jpg", "image/jpeg")
    spine = "".join(f'<itemref idref="d{k}"/>' for k in reversed(ids) if k % 4 != 3)
    cover = '<meta name="cover" content="a"/>' if book % 4 == 1 else ""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        z.writestr("OEBPS/book.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book {book}</dc:title>{cover}</metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>')
        for k, text in docs:
            z.writestr(f"OEBPS/text/{k}.xhtml", _page(k, text or ""))
        z.writestr("OEBPS/text/list.xhtml", "<html><body><p>what is where</p></body></html>")
        z.writestr("OEBPS/images/a.png", b"a" * (1 + book % 9))
        z.writestr(f"OEBPS/images/{'front' if book % 4 == 3 else 'cover'}.jpg", b"c" * (1 + book % 9))
    return out.getvalue()


def _archives(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (book, doc_id, text) sorted by book -> an EPUB of each book, one at a time."""
    rows = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns))
    for book, docs in groupby(rows, key=lambda row: row[0]):
        yield pa.RecordBatch.from_arrays([pa.array([f"b{book}"]), pa.array([_archive(book, [row[1:] for row in docs])], pa.binary())], ["slug", "content"])


def _epubs(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.expr("doc_id div 4").alias("book"), "doc_id", "text")
    damaged = spark.createDataFrame([("damaged", b"PK no archive")], "slug string, content binary")
    sorted_ = docs.repartition("book").sortWithinPartitions("book", "doc_id")
    return sorted_.mapInArrow(_archives, "slug string, content binary").unionByName(damaged)


@query(f"""
WITH c AS (SELECT doc_id, doc_id // 4 AS b, list(paragraph ORDER BY pos) AS paragraphs FROM ({_LINES}) GROUP BY doc_id),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY b ORDER BY doc_id % 4 = 3, CASE WHEN doc_id % 4 = 3 THEN doc_id ELSE -doc_id END) AS INTEGER) AS chapter FROM c WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0)
SELECT 'b' || b AS book, chapter, CASE WHEN doc_id % 7 = 0 THEN 'Rozdzial ' || chapter ELSE 'Doc ' || doc_id END AS title, 'OEBPS/text/' || doc_id || '.xhtml' AS source_ref, paragraphs FROM n
""")
def epub_chapters(spark, d):
    """SC-02, SC-03, SC-04, TX-04: all documents as EPUBs of four, read back as chapters."""
    path = shared_path(spark, "epubs")
    # written, so that those who pack, unpack and read do not all stand at once with their batches
    books.epub_items(_epubs(spark, d)).write.parquet(path)
    items = spark.read.schema(books.EPUB_ITEM).parquet(path)
    return books.epub_chapters(items.filter("error IS NULL")).select("book", "chapter", "title", "source_ref", "paragraphs")


@query("""
WITH b AS (SELECT DISTINCT doc_id // 4 AS b FROM documents)
SELECT 'b' || b AS book, CASE WHEN b % 4 = 2 THEN 'OEBPS/images/cover.jpg' ELSE 'OEBPS/images/a.png' END AS item, repeat(CASE WHEN b % 4 = 2 THEN 'c' ELSE 'a' END, 1 + b % 9) AS content, CAST(NULL AS VARCHAR) AS error FROM b WHERE b % 4 <> 3
UNION ALL SELECT 'damaged', NULL, NULL, 'BadZipFile'
""")
def epub_covers(spark, d):
    """SC-06, and the row of an archive that cannot be read."""
    path = shared_path(spark, "covers")
    # read once, and of each archive only the images
    books.epub_items(_epubs(spark, d), kinds="image/").write.parquet(path)
    items = spark.read.schema(books.EPUB_ITEM).parquet(path)
    covers = books.cover_image(items.filter("error IS NULL")).select("book", "item", F.col("content").cast("string").alias("content"), F.lit(None).cast("string").alias("error"))
    failed = items.filter("error IS NOT NULL").select("book", "item", F.lit(None).cast("string").alias("content"), F.regexp_extract("error", "^[A-Za-z]+", 0).alias("error"))
    return covers.unionByName(failed)


@query(r"""
SELECT item_id, sha256(text || chr(10)) AS sha256, CAST(strlen(text) + 1 AS BIGINT) AS bytes, true AS supported FROM benchmark
""")
def folder_scan(spark, d):
    """SC-08: a file for each passage in folders of their own."""
    folder = shared_path(spark, "files")
    load(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").option("lineSep", "\n").text(folder)
    found = books.scan_folder(spark, folder, recursive=True)
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "sha256", "bytes", "supported")


@query("""
SELECT 'c' || item_id AS id, CAST(item_id % 5 AS INTEGER) AS chapter_index, text, CAST(length(text) AS INTEGER) AS chars, round(length(text) / 15.0, 2) AS est_seconds, item_id % 2 = 0 AS is_dialogue FROM benchmark
""")
def manifest_round_trip(spark, d):
    """SK-02, SC-10: passages as the chunks of five books, written and read strictly."""
    folder, known = shared_path(spark, "manifest"), T._parse_datatype_string(tables.CHUNK).fields
    rows = load(spark, d, "benchmark")
    values = {"id": F.format_string("c%d", "item_id"), "chapter_index": (F.col("item_id") % 5).cast("int"), "text": F.col("text"), "chars": F.length("text"), "est_seconds": F.round(F.length("text") / 15.0, 2), "is_dialogue": F.col("item_id") % 2 == 0}
    plan = rows.select(F.format_string("b%d", F.col("item_id") % 5).alias("book"), *(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in known))
    tables.write_manifest(plan, plan.select("book").distinct(), folder)
    return tables.read_chunks(spark, f"{folder}/chunks").select(*values)


@query("SELECT CAST(user_id AS VARCHAR) AS id, event_type || arg_max(event_id, event_id) AS fingerprint FROM (SELECT user_id, event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS event_type FROM events) GROUP BY user_id, event_type")
def ledger_file(spark, d):
    """SK-03's lines in files that follow each other, with torn ones between, SC-12: of each id the last."""
    path, events = shared_path(spark, "ledger"), load(spark, d, "events")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.concat("event_type", F.col("event_id").cast("string")).alias("fingerprint")))
    lines = events.select("event_id", F.explode(F.array(F.substring(line, 1, 5), line)).alias("value"))
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return tables.read_ledger(spark, path)


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 7 <> 0")
def lenient_lines(spark, d):
    """SC-11: lines of JSON of which every seventh is torn."""
    path, orders = shared_path(spark, "lines"), load(spark, d, "orders")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))
    orders.select(F.when(F.col("o_orderkey") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return tables.read_lenient(spark, path, "id long, price double")


@query("SELECT p_partkey || '.wav' AS filename, p_name || '|' || p_brand AS text FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 10 <> 0")
def dataset_lines(spark, d):
    """SC-16: lines with bars in their text, some without any, some whose file is not there."""
    path, part = shared_path(spark, "dataset"), load(spark, d, "part")
    filename = F.concat(F.col("p_partkey").cast("string"), F.lit(".wav"))
    line = F.when(F.col("p_partkey") % 10 == 0, "no bar").otherwise(F.concat(F.lit(" "), filename, F.lit(" | "), "p_name", F.lit("|"), "p_brand", F.lit(" ")))
    part.select(line.alias("value")).write.text(path)
    return tables.read_dataset(spark, path, part.filter("p_partkey % 3 <> 0").select(filename.alias("filename")))


@query(r"""
SELECT doc_id, nfc_normalize(text) AS text, CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 4 THEN 'utf-32' ELSE 'utf-16' END AS encoding,
  CASE WHEN doc_id % 5 <> 0 THEN 'bom' WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'utf-8' ELSE 'ascii' END AS method, false AS needs_review FROM documents
""")
def decode_marks(spark, d):
    """DC-01, DC-02: all documents in UTF-8, 16 and 32 with and without marks."""
    text, k = F.col("text"), F.col("doc_id") % 5
    marked = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode(text, charset))
    raw = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, marked("efbbbf", "UTF-8")).when(k == 2, marked("fffe", "UTF-16LE")).when(k == 3, marked("feff", "UTF-16BE")).otherwise(marked("0000feff", "UTF-32"))
    found = decoding.decode(load(spark, d, "documents").select("doc_id", raw.alias("content")))
    return found.select("doc_id", "decoded.text", "decoded.encoding", "decoded.method", "decoded.needs_review")
