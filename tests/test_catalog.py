import pytest
from pyspark.sql import functions as F

from folio.operators import catalog, checks, queueing, reports, sets, windows
from folio.sources import tables


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_chapter_marks(spark):
    data = [("b", 0, 1, 1.0, 500), ("b", 1, 1, 2.0, 500), ("b", 2, 2, 1.0, 0), ("b", 3, 1, 1.0, 0)]
    marks = windows.chapter_marks(spark.createDataFrame(data, "book string, order int, chapter_index int, duration_sec double, pause_after_ms int"))
    assert rows(marks, "chapter_index", "start", "end") == [(1, 0.0, 4.0), (1, 5.0, 6.0), (2, 4.0, 5.0)]


def test_unique_slugs(spark):
    data = [(1, "a"), (2, "a"), (3, "a-2"), (4, "b"), (5, "a"), (6, "a-2")]
    taken = spark.createDataFrame([("b",), ("a-3",)], "base string")
    got = windows.unique_slugs(spark.createDataFrame(data, "n int, base string"), "base", "n", taken)
    assert [r[-1] for r in sorted(map(tuple, got.toPandas().itertuples(index=False)))] == ["a", "a-2", "a-2-2", "b-2", "a-4", "a-2-3"]


def test_classify_sources(spark):
    files = spark.createDataFrame([("/in/a", "1", "a"), ("/in/b", "1", "b"), ("/in/c", "2", "c"), ("/in/d", "9", "d"), ("/in/e", "5", "e")], "path string, sha256 string, slug string")
    known = spark.createDataFrame([("old", "9", "/x"), ("moved", "7", "/in/e")], "slug string, sha256 string, source string")
    got = {r["path"]: (r["status"], r["slug"], r["duplicate_of"]) for r in checks.classify_sources(files, known).collect()}
    assert got == {"/in/a": ("new", "a", None), "/in/b": ("duplicate", "b", "/in/a"), "/in/c": ("new", "c", None), "/in/d": ("unchanged", "old", None), "/in/e": ("revised", "moved", None)}


def test_results_that_differ_stop_the_job(spark):
    plan = spark.createDataFrame([("a", "v", "1")], "id string, voice string, fingerprint string")
    assert checks.verified_results(plan, plan).count() == 1
    with pytest.raises(Exception, match="differs from its plan"):
        checks.verified_results(plan.withColumn("voice", F.lit("w")), plan).collect()


def test_models(spark):
    models = spark.createDataFrame([("x", ["pl"]), ("y", ["pl", "en"])], "id string, narration_languages array<string>")
    asked = spark.createDataFrame([(1, "en", None), (2, "pl", "x")], "id int, language string, override string")
    assert rows(catalog.resolve_model(asked, models, "y"), "id", "model") == [(1, "y"), (2, "x")]
    with pytest.raises(Exception, match="does not narrate"):
        catalog.resolve_model(asked.withColumn("override", F.lit("x")), models, "y").collect()


STEPS = [(1, "a", 0, "chunk", "done"), (2, "a", 1, "synth", "pending"), (3, "a", 2, "assemble", "pending"), (4, "b", 0, "chunk", "failed"), (5, "b", 1, "synth", "pending"), (6, "c", 0, "chunk", "pending")]


def queue(spark):
    return spark.createDataFrame(STEPS, "id int, slug string, position int, action string, status string")


def test_queue(spark):
    q = queue(spark)
    assert rows(queueing.ready(q), "id") == [(2,), (6,)] and rows(queueing.next_ready(q, ("synth",)), "id") == [(6,)]
    assert rows(queueing.blocked_by(q), "id", "blocker_id") == [(3, 2), (5, 4)]
    s = queueing.summary(q).first()
    assert (s["pending"], s["done"], s["failed"], s["paused"], s["total"], s["open"]) == (4, 1, 1, 0, 6, 4)
    assert rows(queueing.apply_event(q, "retry", q.filter("id IN (3, 4)")), "id", "status")[3] == (4, "pending")
    jobs = spark.createDataFrame([(7, 0, False), (8, None, False)], "job_id int, exit_code int, alive boolean")
    running = spark.createDataFrame([(1, "running", 7), (2, "running", 8), (3, "pending", 8)], "id int, status string, job_id int")
    assert rows(queueing.settle(running, jobs), "id", "status") == [(1, "done"), (2, "pending"), (3, "pending")]


def test_leases(spark):
    now = F.lit("2024-01-01T00:05:00Z").cast("timestamp")
    data = [(1, "claimed", "", "w", "2024-01-01T00:00:00+00:00", 1), (2, "claimed", "", "w", "2024-01-01T00:00:00+00:00", 3), (3, "claimed", "j", "w", "2024-01-01T00:00:00+00:00", 1), (4, "claimed", "", "w", "2024-01-01T00:04:00", 1)]
    items = spark.createDataFrame(data, "id int, status string, job_id string, claim string, claimed_at string, attempts int")
    assert rows(queueing.expire_leases(items, now), "id", "status") == [(1, "pending"), (2, "paused"), (3, "claimed"), (4, "claimed")]
    assert spark.range(1).select(queueing.age_seconds(F.lit("nonsense"), now)).first()[0] is None


def test_book_words(spark):
    flag = lambda x: F.lit(x).cast("boolean")
    word = lambda *a: spark.range(1).select(queueing.book_state(*(flag(x) for x in a[:4]), F.lit(a[4]))).first()[0]
    assert [word(True, True, False, None, 0), word(True, False, False, None, 0), word(False, False, True, None, 0), word(False, False, False, False, 1), word(False, False, False, True, 1), word(False, False, False, True, 0), word(False, False, False, None, 0)] == ["stale", "rendering", "silence", "failed", "done", "rendered", "prepared"]


def test_maps_and_steps(spark):
    one, two = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))
    assert spark.range(1).select(sets.map_union(one, two)).first()[0] == {"a": 1, "b": 2}
    wanted = spark.range(1).select(sets.steps_for(F.array(F.lit("synth")), F.array(F.lit("assemble")))).first()[0]
    assert wanted == ["synth", "assemble"]


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, order int, v string")
    new = spark.createDataFrame([("b", 2, None), ("c", 3, "z"), ("a", 1, None)], "id string, order int, v string")
    assert [tuple(r) for r in catalog.merge_partial(old, new, "id", "order").collect()] == [("a", 1, None), ("b", 2, None), ("c", 3, "z")]
    assert rows(catalog.upsert(old, new.filter("id = 'a'"), ["id"])) == [("a", 1, None), ("b", 2, None)]


def test_systemic_stop(spark):
    data = [(1, k, "failed", "voice") for k in range(6)] + [(2, k, "failed", ("voice", "model")[k % 2]) for k in range(8)] + [(3, 0, "rendered", None)] + [(3, k, "failed", "model") for k in range(1, 9)]
    got = reports.systemic_stop(spark.createDataFrame(data, "run int, place int, outcome string, kind string"), "run", "place")
    assert rows(got, "run", "stopped_at", "kind") == [(1, 4, "voice")]


def test_manifest_readers(spark, tmp_path):
    good = '{"id":"a","order":0,"text":"x","chars":1}\n\n'
    (tmp_path / "good.jsonl").write_text(good)
    (tmp_path / "extra.jsonl").write_text(good + '{"id":"b","colour":1}\n')
    (tmp_path / "torn.jsonl").write_text('{"id":"a","fingerprint":"1"}\n{"id":"b","fingerprint":"2"}\n{"id":"a","fingerprint":"3"}\n{"id":"c","fin')
    assert tables.read_chunks(spark, str(tmp_path / "good.jsonl")).first()["id"] == "a"
    with pytest.raises(Exception, match="unknown field"):
        tables.read_chunks(spark, str(tmp_path / "extra.jsonl")).collect()
    assert rows(tables.read_ledger(spark, str(tmp_path / "torn.jsonl"))) == [("a", "3"), ("b", "2")]
    assert tables.read_lenient(spark, str(tmp_path / "torn.jsonl"), tables.LEDGER).filter("id IS NOT NULL").count() == 3


def test_configuration(spark, tmp_path):
    (tmp_path / "m.toml").write_text('default = "x"\n[models.x]\nengine = "xtts"\nnarration_languages = ["pl"]\ncontrols = ["speed"]\n[models.x.settings]\nspeed = 1\n')
    models, default = tables.read_registry(str(tmp_path / "m.toml"))
    assert default == "x" and tables.models_table(spark, models).first()["settings"] == {"speed": 1.0}
    (tmp_path / "bad.toml").write_text('[models.x]\nengine = "none"\nnarration_languages = []\n')
    with pytest.raises(ValueError, match="engine, narration languages"):
        tables.read_registry(str(tmp_path / "bad.toml"))
    (tmp_path / "d.yml").write_text("Kelvin: Kelwin\n")
    assert tables.read_dictionary(str(tmp_path / "d.yml")) == {"Kelvin": "Kelwin"} and tables.read_dictionary(str(tmp_path / "none.yml")) == {}
    (tmp_path / "o.json").write_text("{torn")
    assert tables.read_overrides(str(tmp_path / "o.json")) == {}
    (tmp_path / "c.toml").write_text('[[passages]]\nid = "p"\ncategory = "names"\ntext = "Kelvin"\n')
    assert rows(tables.read_corpus(spark, str(tmp_path / "c.toml"))) == [("p", "names", "Kelvin")]


def test_sinks(spark, tmp_path):
    plan = spark.createDataFrame([("b", "a", 1.0, "v"), ("b", "c", 0.1, "w")], "book string, id string, est_seconds double, voice string")
    tables.write_manifest(plan, spark.createDataFrame([("b",)], "slug string"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/chunks")).count() == 2
    for n in "12":
        tables.append_ledger(spark.createDataFrame([("a", n)], "id string, fingerprint string"), str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2
    silent, missing = tables.dry_run(plan, spark.createDataFrame([("v",)], "voice string"))
    assert rows(silent, "id", "duration_sec") == [("a", 1.0), ("c", 0.2)] and rows(missing) == [("w",)]
    assert tables.publish_text(str(tmp_path / "x/y.txt"), "whole") and (tmp_path / "x/y.txt").read_text() == "whole"
    assert tables.schema_drift({"old": "1"}, tables.schemas()) == sorted(["old", *tables.schemas()])
