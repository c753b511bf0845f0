import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.operators import chunking, language, roles, speech
from folio.sources import books


def pack(spark, sentences, limit=224, min_chars=40):
    rows = spark.createDataFrame([(sentences, limit)], "s array<string>, limit int")
    return rows.select(chunking.pack(F.col("s"), F.col("limit"), min_chars)).first()[0]


def test_packing(spark):
    assert pack(spark, []) == [] and pack(spark, ["Tak."]) == ["Tak."]
    long = "Zdanie, które ma więcej niż czterdzieści znaków razem."
    assert pack(spark, [long, "Tak."]) == [f"{long} Tak."] and pack(spark, ["Tak.", long]) == [f"Tak. {long}"]
    got = pack(spark, ["Przed nim krótkie zdanie.", "b" * 600, "Po nim kolejne zdanie."])
    assert all(len(x) <= 224 for x in got) and sum(x.count("b") for x in got) == 600


def test_packing_keeps_every_word_in_order(spark):
    rng = random.Random(2)
    for limit in (20, 60, 224):
        sentences = [" ".join("w" * rng.randrange(1, 30) + rng.choice([",", ";", ""]) for _ in range(rng.randrange(1, 30))) for _ in range(12)]
        got = pack(spark, sentences, limit)
        assert max(map(len, got)) <= limit
        assert "".join(got).replace(" ", "") == "".join(sentences).replace(" ", "")


def folded(pieces, limit):
    out = []
    for x in pieces:
        if out and len(out[-1]) + 1 + len(x) <= limit:
            out[-1] += " " + x
        else:
            out.append(x)
    return out


def test_fold_is_that_of_one_piece_after_another(spark):
    rng = random.Random(8)
    words = lambda: ["".join(rng.choice("aż😀\n.,$\\\u0001" if rng.random() < 0.1 else "aż😀.") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(40))]
    rows = [(k, words(), rng.randrange(1, 40)) for k in range(300)]
    found = spark.createDataFrame(rows, "k int, p array<string>, n int").select("k", chunking._fold(F.col("p"), F.col("n"))).collect()
    assert {r[0]: r[1] for r in found} == {k: folded(p, n) for k, p, n in rows}


def test_packing_time_grows_with_the_text(spark):
    """40,000 words: a fold that copies what it has made takes minutes."""
    began = time.time()
    got = pack(spark, ["ab"] * 40_000, 5, 0)
    assert got == ["ab ab"] * 20_000 and time.time() - began < 20


def test_hard_split_prefers_clauses(spark):
    row = spark.createDataFrame([("first part, second part; third",)], "s string")
    assert row.select(chunking.hard_split(F.col("s"), F.lit(12))).first()[0] == ["first part,", "second part;", "third"]


def test_sentences(spark):
    text = 'Dr. Lem came. "Why?" asked Ann. It was 3.5 m… Then 7 men left! ok. yes'
    row = spark.createDataFrame([(text,)], "s string")
    assert row.select(chunking.sentences(F.col("s"))).first()[0] == ["Dr. Lem came.", '"Why?" asked Ann.', "It was 3.5 m…", "Then 7 men left! ok. yes"]


def test_sentences_as_in_sql(spark):
    import duckdb

    from folio.plans.books import _SENTENCES

    texts = ["la no. No. Rr queme.", "No. No. No. No. 5 x", "a. Dr. Mr. Lem. Ok", "(no. No. 5) x. Y", "²dr. Lem. Ⓐno. Ⓑ. ‿No. A", "é no. éno. A", "ınż. A İnż. B INŻ. C inż. D", "ſra. A ſt. B ß. \"No. 5", "xNo. No. A"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, p string")
    found = [r[1] for r in rows.select("k", chunking.sentences(F.col("p"))).orderBy("k").collect()]
    assert found == [duckdb.execute(f"SELECT {_SENTENCES} FROM (SELECT CAST(? AS VARCHAR) AS p)", [t]).fetchone()[0] for t in texts]
    assert found[0] == ["la no. No.", "Rr queme."]


BOOK = "front words here\n\n# Przybysz\n\nZszedłem po drabince. Ocean falował.\n\nKelvin: — Nie wiem, po co tu przyleciałem.\n\n## Sołaris\n\nKoniec i kropka.\n\n# Pusty\n\n"


def test_chapters_and_plan(spark):
    rows = spark.createDataFrame([(1, "solaris.txt", BOOK), (2, "x.txt", "No heading at all."), (3, "none.txt", None)], "book long, name string, text string")
    found = chunking.chapters(rows).orderBy("book", "chapter").collect()
    assert [(r["book"], r["chapter"], r["title"], r["source_ref"]) for r in found] == [(1, 1, "solaris", "solaris.txt#0"), (1, 2, "Przybysz", "solaris.txt#1"), (1, 3, "Sołaris", "solaris.txt#3"), (2, 1, "x", "x.txt#0")]
    languages = spark.createDataFrame([(1, "pl")], "book long, language string")
    plan = chunking.chunk_plan(chunking.chapters(rows), languages).orderBy("book", "order").collect()
    first = [r for r in plan if r["book"] == 1]
    assert [r["order"] for r in first] == list(range(len(first))) and first[0]["kind"] == "heading" and first[0]["pause_after_ms"] == 900
    assert first[2]["id"] == "ch002_0002" and first[2]["text"] == "Przybysz"
    assert all(r["est_seconds"] == round(r["chars"] / 15, 2) for r in plan)


def test_chunk_plan_as_in_sql(spark, tmp_path):
    import random

    import duckdb
    import pandas as pd

    from folio.plans import registry

    rng = random.Random(4)
    words = ["no.", "No.", "Dr.", "Sr.", "vol.", "Rr", "que", "ñas,", "x;", "y.", "Ya?", '"Si."', "5", "–", "w" * 300, "\n", "\n"]
    texts = ["Cira la no. No. Lo llmi con.", None, ""] + [" ".join(rng.choices(words, weights=[4] * 14 + [1] * 3, k=rng.randrange(200))) for _ in range(300)]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": [("es", "en", "xx", None)[k % 4] for k in range(len(texts))]})
    docs.to_parquet(tmp_path / "documents.parquet")
    found = registry.QUERIES["chunk_plan"](spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", docs)
    wanted = con.execute("SELECT " + ", ".join(f'"{c}"' for c in found.columns) + f" FROM ({registry.ORACLES['chunk_plan']})").fetchall()
    assert set(map(tuple, found.collect())) == set(wanted) and len(wanted) == found.count()


@pytest.mark.parametrize(
    "paragraph,known,want",
    [
        ("Zszedłem po drabince.", [], ("narrator", False, None)),
        ("„Nie wiem, czy to możliwe.”", [], ("dialogue", True, None)),
        ("Kelvin: — Wracam na Ziemię.", ["kelvin"], ("kelvin", True, "— Wracam na Ziemię.")),
        ("Kelvin: Wracam na Ziemię.", ["kelvin"], ("kelvin", True, "Wracam na Ziemię.")),
        ("Snaut: — Nie ma nikogo.", ["kelvin"], ("dialogue", True, "— Nie ma nikogo.")),
        ("Uwaga: to zdanie ma dwukropek, nie jest dialogiem.", [], ("narrator", False, None)),
        ("— Witaj — powiedziała.", [], ("narrator", False, None)),
        ("", [], ("narrator", False, None)),
        (None, [], ("narrator", False, None)),
    ],
)
def test_roles(spark, paragraph, known, want):
    row = spark.createDataFrame([(paragraph, known)], "p string, known array<string>")
    got = row.select(roles.assign_role(F.col("p"), F.col("known")).alias("r")).first()["r"]
    assert (got["role"], got["is_dialogue"], got["text"]) == want


def test_cast(spark):
    cast = spark.createDataFrame([("narrator", "n"), ("kelvin", "k")], "role string, voice string")
    rows = spark.createDataFrame([(1, "kelvin"), (2, "snaut"), (3, None)], "id int, role string")
    assert {r["id"]: r["voice"] for r in roles.resolve_cast(rows, cast).collect()} == {1: "k", 2: "n", 3: "n"}
    named = spark.createDataFrame([("Pani Kelvin",), ("O'Neil_x ",)], "c string").select(roles.normalise_speaker(F.col("c"))).collect()
    assert [r[0] for r in named] == ["pani-kelvin", "oneil-x"]


@pytest.mark.parametrize(
    "text,lang,dictionary,want",
    [
        ("Spotkałem dr. tam", "pl", {}, "Spotkałem doktor tam"),
        ("Byli tam m.in. sąsiedzi", "pl", {}, "Byli tam między innymi sąsiedzi"),
        ("Dr. Kelvin przyszedł", "pl", {}, "Doktor Kelvin przyszedł"),
        ("Piękny widok.", "pl", {}, "Piękny widok."),
        ("To jest ok", "pl", {}, "To jest ok"),
        ("Fruit, e.g. apples", "en", {}, "Fruit, for example apples"),
        ("It cost ok. five", "en", {}, "It cost ok. five"),
        ("Der Ozean wogte unter der Station.", "de", {}, "Der Ozean wogte unter der Station."),
        ("Wzrost o 15%", "pl", {}, "Wzrost o 15 procent"),
        ("Wzrost o 15 %", "pl", {}, "Wzrost o 15 procent"),
        ("Było 21°C w kabinie", "pl", {}, "Było 21 stopni Celsjusza w kabinie"),
        ("Kris Kelvin wrócił", "pl", {"Kelvin": "Kelwin", "Kris Kelvin": "Krys Kelwin"}, "Krys Kelwin wrócił"),
        ("Kelvinometr", "pl", {"Kelvin": "Kelwin"}, "Kelvinometr"),
    ],
)
def test_speech(spark, text, lang, dictionary, want):
    row = speech.prepare(spark.createDataFrame([(1, lang, text)], "id int, language string, text string"), dictionary).first()
    assert row["text"] == want and row["source_text"] == text
    for s in row["substitutions"]:
        assert text[s["start"] : s["end"]] == s["source"] and want[s["spoken_start"] : s["spoken_end"]] == s["spoken"]


def test_preview(spark):
    chunks = spark.createDataFrame([(0, "Kelvin spotkał Kelvina. Kelvin!"), (1, "nic")], "order int, text string")
    entries = spark.createDataFrame([("Kelvin", "Kelwin"), ("Gibarian", "x")], "written string, spoken string")
    counts, first, unused = speech.preview(chunks, entries)
    assert [tuple(r) for r in counts.collect()] == [("Kelvin", 2)] and [r["start"] for r in first.orderBy("start").collect()] == [0, 24]
    assert [r["written"] for r in unused.collect()] == ["Gibarian"]


def chapters(spark, texts):
    rows = [(1, k + 1, f"c{k}", [t]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book int, chapter int, source_ref string, paragraphs array<string>")


def decide(spark, texts, metadata="", override=""):
    samples = language.gather_samples(chapters(spark, texts)).withColumn("l", language.classify(F.col("sample")))
    samples = samples.select("book", F.length("sample").alias("chars"), F.col("l.language").alias("language"), F.col("l.confidence").alias("confidence"))
    meta = spark.createDataFrame([(1, metadata, override)], "book int, metadata_language string, override string")
    return language.decide(samples, meta).first()


POLISH = "Nie wiem, czy to jest ocean, ale na pewno był tam ktoś i się do mnie odezwał po raz pierwszy z daleka. " * 6
ENGLISH = "The ocean was on this planet and it is not the one that we were looking for as he said to her at night. " * 6
GERMAN = "Der Ozean ist nicht das, was ich mit dem Wort sie und auf der Station für den Weg als ein Zeichen sah. " * 6


def test_language(spark):
    assert decide(spark, [POLISH])["language"] == "pl" and decide(spark, [ENGLISH] * 7)["language"] == "en"
    assert decide(spark, [GERMAN])["reason"] == "unsupported language"
    assert decide(spark, [POLISH, ENGLISH])["reason"] == "passages disagree"
    assert decide(spark, ["Krótko."])["reason"] == "too little text"
    told = decide(spark, [POLISH], metadata="en-GB")
    assert told["language"] == "pl" and told["warning"] == "metadata disagrees with text"
    forced = decide(spark, [POLISH], override="en")
    assert (forced["language"], forced["method"], forced["warning"]) == ("en", "override", "text disagrees with override")


def test_samples_are_spread(spark):
    got = language.gather_samples(chapters(spark, [ENGLISH] * 12)).orderBy("place").collect()
    assert sorted(r["place"] for r in got) == sorted(f"c{k}" for k in (0, 3, 6, 9, 11))


def epub(spine=True):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        items = '<item id="b" href="two.xhtml" media-type="application/xhtml+xml"/><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="i" href="cover.jpg" media-type="image/jpeg" properties="cover-image"/>'
        z.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></metadata><manifest>{items}</manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("OPS/one.xhtml", "<html><head><title>x</title></head><body><h1>Pierwszy</h1><p>Ala <sup>1</sup>ma kota.</p><blockquote><p>zagnieżdżony akapit</p></blockquote></body></html>")
        z.writestr("OPS/two.xhtml", "<body>Tekst bez akapitów.\n\nDrugi blok.</body>")
        z.writestr("OPS/nav.xhtml", "<body><p>spis</p></body>")
        z.writestr("OPS/cover.jpg", b"jpg")
    return data.getvalue()


def test_epub(spark):
    files = spark.createDataFrame([("dobra", epub()), ("zepsuta", b"no zip")], "slug string, content binary")
    items = books.epub_items(files).cache()
    found = books.epub_chapters(items).orderBy("chapter").collect()
    assert [(r["chapter"], r["title"], r["paragraphs"]) for r in found] == [(1, "Pierwszy", ["Ala ma kota.", "zagnieżdżony akapit"]), (2, "Rozdzial 2", ["Tekst bez akapitów.", "Drugi blok."])]
    assert [tuple(r) for r in books.cover_image(items).select("book", "item").collect()] == [("dobra", "OPS/cover.jpg")]
    assert items.filter("error IS NOT NULL").select("book").first()[0] == "zepsuta"


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(BOOK.encode("cp1250"))
    (tmp_path / "b.epub").write_bytes(epub())
    (tmp_path / "c.pdf").write_bytes(b"x")
    (tmp_path / ".hidden.txt").write_bytes(b"x")
    found = books.scan_folder(spark, str(tmp_path))
    assert [(r["name"], r["supported"]) for r in found.collect()] == [("a.txt", True), ("b.epub", True), ("c.pdf", False)]
    text = books.text_books(found.filter("name = 'a.txt'"))
    assert {r["title"] for r in text.collect()} == {"a", "Przybysz", "Sołaris"}
