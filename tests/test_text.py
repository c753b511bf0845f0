import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folio.functions import decoding
from folio.functions import text as tx


def apply(spark, function, values, schema="c string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {schema}")
    return [r[0] for r in rows.orderBy("k").select(function(F.col("c"))).collect()]


def test_slugs(spark):
    values = ["Żmija w gąszczu", "Sołaris i Ocean", "Łódź", "Straße", "???", "Œuvre  --  ﬁn", ""]
    assert apply(spark, tx.slugify, values) == ["zmija-w-gaszczu", "solaris-i-ocean", "lodz", "strasse", "book", "oeuvre-fin", "book"]
    assert apply(spark, tx.filename_slug, ["a/b/Mój plik.TXT", ".txt", "--.epub"]) == ["moj-plik", "txt", "upload"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("słowo — drugie", "słowo - drugie"),
        ("słowo – drugie", "słowo - drugie"),
        ("„cytat”", '"cytat"'),
        ("‘a’", "'a'"),
        ("czekaj…", "czekaj..."),
        ("mo­że", "może"),
        ("kon-\nstrukcja", "konstrukcja"),
        ("kon- \r\n strukcja", "konstrukcja"),
        ("słowo[12] dalej", "słowo dalej"),
        ("słowo{7} dalej", "słowo dalej"),
        ("słowo(3) dalej", "słowo dalej"),
        ("rok (1984) dalej", "rok (1984) dalej"),
        ("a      b\t\tc", "a b c"),
    ],
)
def test_normalise(spark, given, want):
    assert apply(spark, tx.normalise, [given]) == [want]


def test_paragraphs_and_words(spark):
    assert apply(spark, tx.paragraphs, ["a b\n \nx\n\n c\nd "]) == [["a b", "c d"]]
    assert apply(spark, tx.word_count, ["  a b\n c ", "", None]) == [3, 0, 0]
    assert apply(spark, tx.comparison_tokens, ["Ocean, FALOWAŁ_tu! -"]) == [["ocean", "falował_tu"]]


def test_labels(spark):
    seconds = [0.0, 59.9996, 3725.25]
    assert apply(spark, tx.timestamp_label, seconds, "c double") == ["00:00:00.000", "00:00:59.999", "01:02:05.250"]
    assert apply(spark, tx.duration_label, seconds, "c double") == ["0s", "59s", "1h 02m"]
    assert apply(spark, tx.size_label, [0, 1023, 1536, 5 * 1024**2, 3 * 1024**4], "c long") == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3072.0 GB"]
    assert apply(spark, tx.parse_bitrate, ["64k", "1.5M", "128000", "fast", None, " 96K "]) == [64000, 1500000, 128000, 64000, 64000, 96000]


def test_names_and_escapes(spark):
    assert apply(spark, tx.is_safe_name, ["a.b-c_1", "-a", "", None, "a" * 101, "a/b", "a\n"]) == [True, False, False, False, False, False, False]
    assert apply(spark, tx.metadata_value, ["a=b;c#d\\e\r\nf"]) == ["a\\=b\\;c\\#d\\\\e\\\nf"]
    assert apply(spark, tx.concat_line, ["it's.wav"]) == ["file 'it'\\''s.wav'"]
    assert apply(spark, tx.language_code, ["pl-PL", "en_GB", " DE ", None]) == ["pl", "en", "de", ""]
    assert apply(spark, tx.is_front_matter, ["Spis treści", "COPYRIGHT 2020", "Rozdział 1", None]) == [True, True, False, False]
    assert apply(spark, lambda c: tx.is_contained(F.lit("/data/books"), c), ["/data/books/a", "/data/booksx", "/data/books/../x"]) == [True, False, False]


def test_labels_round_as_c_does(spark):
    rng = random.Random(5)
    sizes = [0.5, 1.5, 1023.5, None, 92416.0, 968960.0, 0.45 * 1024**2, *(k * 64.0 for k in range(16, 400)), *(round(rng.uniform(0, 1e10) / 10 ** rng.randrange(8), 2) for _ in range(2000))]
    want = [None if x is None else f"{x:.0f} B" if x < 1024 else f"{x / 1024:.1f} KB" if x < 1024**2 else f"{x / 1024**2:.1f} MB" if x < 1024**3 else f"{x / 1024**3:.1f} GB" for x in sizes]
    assert apply(spark, tx.size_label, sizes, "c double") == want
    # sums that round to a half from either side
    near = [y for k in range(1, 300) for y in (math.nextafter(k + 0.05, 0), k + 0.05, math.nextafter(k + 0.05, 1e9))]
    assert apply(spark, tx.size_label, [x * 1024 for x in near], "c double") == [f"{x:.1f} KB" for x in near]
    assert apply(spark, tx.timestamp_label, [None, 61.5], "c double") == [None, "00:01:01.500"]
    assert apply(spark, tx.duration_label, [None, 61.5], "c double") == [None, "1m 01s"]


def test_excerpt(spark):
    text = "a" * 100 + "WORD" + "b" * 100
    got = apply(spark, lambda c: tx.excerpt(c, F.lit(100), F.lit(104), 20), [text, "x WORD y"])
    assert got[0] == "…" + "a" * 8 + "WORD" + "b" * 8 + "…"


def test_quality_prefers_the_right_table(spark):
    polish = "Zażółć gęślą jaźń, powiedział ktoś. " * 20
    wrong = polish.encode("iso-8859-2").decode("cp1250", errors="replace")
    right, bad, nothing, digits = apply(spark, tx.text_quality, [polish, wrong, "", "123"])
    assert right == 1.0 and bad < 0 and nothing == 0.0 and digits == 0.0


def test_marks_and_families(spark):
    marks = [b"\xef\xbb\xbfa", b"\xff\xfe\0\0", b"\xff\xfea", b"\0\0\xfe\xff", b"plain"]
    assert apply(spark, tx.bom_encoding, marks, "c binary") == ["utf-8-sig", "utf-32", "utf-16", "utf-32", None]
    assert apply(spark, tx.encoding_family, ["UTF_8-SIG", "utf-16-le", "cp1250"]) == ["utf-8", "utf-16", "cp1250"]


POLISH = "Ocean falował pod stacją. Zażółć gęślą jaźń, pomyślał Kelvin i wrócił do łóżka. " * 5


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1250", "iso-8859-2"])
def test_decoding_round_trip(spark, encoding):
    rows = spark.createDataFrame([(POLISH.encode(encoding),)], "content binary")
    got = decoding.decode(rows).select("decoded.*").first()
    assert got["text"] == POLISH and got["error"] is None and not got["needs_review"]
    assert got["encoding"] == encoding


def test_decoding_odd_files(spark):
    rows = [(1, b"ascii"), (2, bytes.fromhex("818d8f909d") * 60), (3, "café".encode()), (4, None), (5, b"")]
    got = {r["k"]: r["decoded"] for r in decoding.decode(spark.createDataFrame(rows, "k int, content binary")).collect()}
    assert got[1]["method"] == "ascii" and "cp1250" in got[1]["equivalent"]
    assert got[2]["encoding"] == "iso-8859-2" and got[2]["needs_review"]
    assert got[3]["text"] == unicodedata.normalize("NFC", "café")
    assert got[5]["text"] == ""
    forced = decoding.decode(spark.createDataFrame([(b"\xff\xfeab",), (b"\x81",)], "content binary"), override="cp1250").select("decoded.*").collect()
    assert forced[0]["method"] == "override" and forced[0]["warnings"] == ["mark says utf-16"]
    assert forced[1]["error"] == "not valid cp1250" and forced[1]["text"] is None
