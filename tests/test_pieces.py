"""Bounded pieces: no whole batch stands as Python objects, and files are read in order."""

import pyarrow as pa

from folio import io
from folio.plans import sources
from folio.sources import books, tables


def test_in_pieces_holds_few_values(monkeypatch):
    sizes, array = [], pa.array
    monkeypatch.setattr(io.pa, "array", lambda values, kind: sizes.append(len(values)) or array(values, kind))
    assert io.in_pieces(range(100), lambda k: (str(k), 10), pa.string(), 100).to_pylist() == [str(k) for k in range(100)]
    assert max(sizes) <= 11
    assert io.in_pieces([], lambda k: (k, 1), pa.string()).to_pylist() == []


def test_byte_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 60, None, "b" * 60, "", "c" * 500, "d"])], ["text"])
    parts = list(io.byte_slices(batch, "text", 100))
    assert [p.num_rows for p in parts] == [2, 2, 1, 1] and pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert not list(io.byte_slices(batch.slice(6), "text", 100))


def test_only_wanted_items_are_unpacked():
    found = list(books._open_epub(sources._archive(4, [(16, "x"), (17, None)]), "image/"))
    assert {i["item"] for i in found} == {"OEBPS/images/a.png", "OEBPS/images/cover.jpg"} and [i["manifest"] for i in found] == [4, 5]


def test_books_follow_each_other():
    batches = [pa.RecordBatch.from_pydict({"book": [1, 1], "doc_id": [4, 5], "text": ["a", "b"]}), pa.RecordBatch.from_pydict({"book": [1, 2], "doc_id": [6, 8], "text": ["c", None]})]
    made = [b.to_pylist()[0] for b in sources._archives(batches)]
    assert [m["slug"] for m in made] == ["b1", "b2"]
    assert [sum("xhtml" in i["kind"] for i in books._open_epub(m["content"])) for m in made] == [4, 2]


def test_ledger_of_several_files(spark, tmp_path):
    """The last file by name counts, though a larger one before it is read first."""
    line = '{"id": "a", "fingerprint": "%s"}\n'
    (tmp_path / "part-00000.txt").write_text((line % "old") * 3000 + line % "b0")
    (tmp_path / "part-00001.txt").write_text(line % "new")
    assert [tuple(r) for r in tables.read_ledger(spark, str(tmp_path)).collect()] == [("a", "new")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert [tuple(r) for r in tables.read_ledger(spark, str(tmp_path / "part-00000.txt")).collect()] == [("a", "b0")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_are_read_once(spark):
    """Filters on what was read are not pushed below it: each Python function stands in the plan once."""
    items = spark.createDataFrame([], books.EPUB_ITEM)
    plan = books.epub_chapters(items)._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line for line in plan.split("\n")) == 2 and sum("MapInArrow" in line for line in plan.split("\n")) == 1


def test_pages_are_parsed_in_small_batches():
    pages = pa.RecordBatch.from_pydict({"book": ["a"] * 9, "html": ["<h1>T</h1><p>" + "x" * 400_000 + "</p>"] * 8 + [None]})
    made = list(books._parse([pages]))
    assert max(m.num_rows for m in made) <= 3 and sum(m.num_rows for m in made) == 9
    found = pa.Table.from_batches(made).column("found").to_pylist()
    assert found[0] == {"title": "T", "blocks": ["x" * 400_000], "body": "T" + "x" * 400_000} and found[8] == {"title": None, "blocks": [], "body": ""}
