"""Books from folders: plain text and EPUB, as tables of chapters."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from folio.functions import decoding
from folio.functions import text as tx
from folio.io import byte_slices, in_pieces

# Suffixes that can be read, names of navigation documents, and when an extracted document is suspect.
SUFFIXES = (".txt", ".epub")
NAVIGATION = r"(?i)(^|/)(nav|toc|contents|ncx)\.x?html?$"
POOR_DOCUMENT, POOR_CHARS = 0.5, 200
COVER_TYPES = ("jpg", "jpeg", "png", "webp")

_VOID = {"br", "img", "hr", "meta", "link", "input"}
_HIDDEN = {"script", "style", "sup", "table", "figure"}
_BLOCKS = {"p", "blockquote", "li"}


class _Blocks(HTMLParser):
    """Text of outermost blocks, the first heading, and all body text, without what is not read aloud."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.body, self.title, self.hidden, self.depth, self.heading, self.in_head = [], [], None, 0, 0, None, False

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "head":
            self.in_head = True
        elif tag in _BLOCKS:
            self.depth += 1
            if self.depth == 1:
                self.blocks.append([])
        elif tag in ("h1", "h2", "h3") and self.title is None and self.heading is None:
            self.heading = []
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "head":
            self.in_head = False
        elif tag in _BLOCKS:
            self.depth = max(0, self.depth - 1)
        elif tag in ("h1", "h2", "h3") and self.heading is not None:
            self.title, self.heading = "".join(self.heading), None

    def handle_data(self, data):
        if self.hidden or self.in_head:
            return
        self.body.append(data)
        if self.heading is not None:
            self.heading.append(data)
        if self.depth:
            self.blocks[-1].append(data)


_FOUND = pa.struct([("title", pa.string()), ("blocks", pa.list_(pa.string())), ("body", pa.string())])


def _parsed(page: pa.Scalar) -> tuple[dict, int]:
    parser, text = _Blocks(), page.as_py() or ""
    parser.feed(text)
    parser.close()
    return {"title": parser.title, "blocks": ["".join(b) for b in parser.blocks], "body": "".join(parser.body)}, len(text)


_FOUND_TYPE = T.StructType().add("title", "string").add("blocks", T.ArrayType(T.StringType())).add("body", "string")


@arrow_udf(_FOUND_TYPE)
def html_blocks(pages: pa.Array) -> pa.Array:
    """SC-05: the first heading, the text of outermost paragraphs, quotations and list items, and all text."""
    return in_pieces(pages, _parsed, _FOUND)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """html_blocks of rows whose last column is the page, in batches of about 1 MB of pages."""
    for batch in batches:
        for part in byte_slices(batch, "html", 1_000_000):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], in_pieces(part.column(part.num_columns - 1), _parsed, _FOUND)], [*part.schema.names[:-1], "found"])


def html_paragraphs(html: Column, footnotes: bool = True) -> Column:
    """SC-05: normalised paragraphs of a document; without any block, its text between blank lines."""
    return _paragraphs_of(html_blocks(html), footnotes)


def _paragraphs_of(found: Column, footnotes: bool) -> Column:
    blocks = F.filter(F.transform(found["blocks"], lambda b: tx.normalise(b, footnotes)), lambda b: F.length(b) > 1)
    return F.when(F.size(found["blocks"]) > 0, blocks).otherwise(tx.paragraphs(found["body"], footnotes))


def is_navigation(name: Column, properties: Column) -> Column:
    """SC-04."""
    return F.coalesce(name, F.lit("")).rlike(NAVIGATION) | F.coalesce(F.array_contains(properties, "nav"), F.lit(False))


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False, slug_for: Callable[[Column], Column] = tx.filename_slug) -> DataFrame:
    """SC-08: the folder's files by path with bytes and digest; hidden ones left out, other suffixes unsupported.

    slug_for (UD-02) names a book by a Column of its file's name."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    rows = files.select("path", name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), slug_for(name).alias("slug"), suffix.isin(*SUFFIXES).alias("supported"), "content")
    return rows.filter(~F.col("name").startswith(".")).orderBy("path")


def known_books(spark: SparkSession, root: str) -> DataFrame:
    """SC-09: (slug, sha256, source) of imported books; metadata that cannot be read is skipped."""
    schema = "meta struct<slug:string,source_sha256:string,original_source:string,title:string,author:string>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/*/chapters.json")
    return rows.filter("meta.slug IS NOT NULL").select("meta.slug", F.col("meta.source_sha256").alias("sha256"), F.col("meta.original_source").alias("source"), "meta.title", "meta.author")


def text_books(files: DataFrame, encoding: str = "", strip_footnotes: bool = True) -> DataFrame:
    """SC-01: chapters of plain-text files (slug, name, content)."""
    from folio.operators.chunking import chapters

    read = decoding.decode(files, override=encoding).filter("decoded.error IS NULL")
    return chapters(read.select(F.col("slug").alias("book"), "name", F.col("decoded.text").alias("text")), strip_footnotes)


def _open_epub(content: bytes, kinds: str = "") -> Iterator[dict]:
    """Content documents and images of an EPUB with their place in the spine, their properties and their role."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        local = lambda e: e.tag.rpartition("}")[2]
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if local(e) == "rootfile")
        package, base = ElementTree.fromstring(archive.read(opf)), posixpath.dirname(opf)
        spine = {e.attrib.get("idref"): k for k, e in reversed(list(enumerate(x for x in package.iter() if local(x) == "itemref")))}
        cover = next((e.attrib.get("content") for e in package.iter() if local(e) == "meta" and e.attrib.get("name") == "cover"), None)
        meta = {local(e): e.text for e in package.iter() if local(e) in ("title", "creator", "language") and e.text}
        there = set(archive.namelist())
        for place, item in enumerate(e for e in package.iter() if local(e) == "item"):
            name = posixpath.normpath(posixpath.join(base, item.attrib.get("href", "")))
            if name not in there or not item.attrib.get("media-type", "").lower().startswith(kinds):
                continue
            kind, properties = item.attrib.get("media-type", ""), item.attrib.get("properties", "").split()
            yield {"item": name, "kind": kind, "properties": properties, "spine": spine.get(item.attrib.get("id")), "manifest": place, "content": archive.read(name), "is_cover_meta": cover is not None and item.attrib.get("id") == cover, "title": meta.get("title"), "author": meta.get("creator"), "language": meta.get("language")}


EPUB_ITEM = "book string, item string, kind string, properties array<string>, spine int, manifest int, content binary, is_cover_meta boolean, title string, author string, language string, error string"


def epub_items(files: DataFrame, kinds: str = "") -> DataFrame:
    """SC-02: the items of EPUB files (slug, content); a damaged file is one row with its error.

    kinds: what the media types of the wanted items begin with; others are not unpacked."""

    names = [c.split(" ")[0] for c in EPUB_ITEM.split(", ")]
    types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slug, content in zip(*batch.columns):
                try:
                    rows = [{"book": slug.as_py(), "error": None} | item for item in _open_epub(content.as_py(), kinds)]
                except Exception as e:  # a damaged book costs its own row
                    rows = [dict.fromkeys(names) | {"book": slug.as_py(), "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types))))

    return files.select("slug", "content").mapInArrow(run, EPUB_ITEM)


def spine_order(spine: Column, manifest: Column) -> Column:
    """SC-03: the spine's order, then what it forgot in the manifest's order."""
    return F.struct(F.coalesce(spine, F.lit(1 << 30)).alias("spine"), manifest.alias("manifest"))


def epub_chapters(items: DataFrame, strip_front_matter: bool = True, strip_footnotes: bool = True) -> DataFrame:
    """SC-02: (book, chapter, title, source_ref, paragraphs, needs_review) of EPUB items."""
    from pyspark.sql import Window

    docs = items.filter(F.col("kind").contains("html") & ~is_navigation(F.col("item"), F.col("properties")))
    read = decoding.decode(docs).withColumn("html", F.coalesce("decoded.text", F.lit("")))
    # not html_blocks(): a filter on what a function gives would be pushed below it, and decode and parse all pages again
    read = read.select("book", "item", "spine", "manifest", "html")
    rows = read.mapInArrow(_parse, T.StructType(read.schema.fields[:-1]).add("found", _FOUND_TYPE))
    rows = rows.select("book", "item", spine_order(F.col("spine"), F.col("manifest")).alias("place"), tx.normalise(F.coalesce("found.title", F.lit("")), strip_footnotes).alias("title"), _paragraphs_of(F.col("found"), strip_footnotes).alias("paragraphs"))
    rows = rows.filter(F.size("paragraphs") > 0)
    if strip_front_matter:
        rows = rows.filter(~tx.is_front_matter(F.col("title")))
    number = F.row_number().over(Window.partitionBy("book").orderBy("place"))
    body = F.array_join("paragraphs", " ")
    rows = rows.withColumn("chapter", number)
    title = F.when(F.col("title") == "", F.concat(F.lit("Rozdzial "), F.col("chapter").cast("string"))).otherwise(F.col("title"))
    return rows.select("book", "chapter", title.alias("title"), F.col("item").alias("source_ref"), "paragraphs", ((F.length(body) > POOR_CHARS) & (tx.text_quality(body) < POOR_DOCUMENT)).alias("needs_review"))


def cover_image(items: DataFrame) -> DataFrame:
    """SC-06: of each book the image its properties, then its metadata, then its name call the cover."""
    usable = items.filter(F.col("kind").rlike("(?i)image/(" + "|".join(COVER_TYPES) + ")") & (F.octet_length("content") > 0))
    stem = F.lower(F.regexp_extract("item", r"([^/]*)$", 1))
    priority = F.when(F.array_contains("properties", "cover-image"), 1).when(F.col("is_cover_meta"), 2).when(stem.startswith("cover"), 3)
    ranked = usable.withColumn("priority", priority).filter(F.col("priority").isNotNull())
    return ranked.groupBy("book").agg(F.min_by(F.struct("item", "content"), F.struct("priority", "manifest")).alias("cover")).select("book", "cover.item", "cover.content")


def pdf_books(files: DataFrame) -> DataFrame:
    """SC-07: PDF files (slug, name, content) as one chapter each (book, name, text, error). Needs pypdf on the executors;
    without it, and for damaged files, the row says so."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pypdf
        except ImportError:
            pypdf = None
        for frame in frames:
            out = []
            for slug, name, content in zip(frame["slug"], frame["name"], frame["content"]):
                try:
                    if pypdf is None:
                        raise RuntimeError("pypdf is not installed")
                    pages = pypdf.PdfReader(io.BytesIO(bytes(content))).pages
                    out.append((slug, name, "\n\n".join(p.extract_text() or "" for p in pages), None))
                except Exception as e:  # a damaged book costs its own row
                    out.append((slug, name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["book", "name", "text", "error"])

    return files.select("slug", "name", "content").mapInPandas(run, "book string, name string, text string, error string")
