import hashlib
import json

from pyspark.sql import functions as F

from folio.functions import identity


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def fingerprint(spark, **change):
    values = {"text": "Ocean falował pod stacją.", "language": "pl", "model": "xtts-v2@abc123", "voice": "michal", "revision": "deadbeef"} | {k: v for k, v in change.items() if k != "settings"}
    settings = change.get("settings", {"temperature": 0.7, "speed": 1.0})
    pairs = F.create_map(*(F.lit(x) for k, v in settings.items() for x in (k, float(v))))
    return one(spark, identity.fragment_fingerprint(*(F.lit(values[k]) for k in ("text", "language", "model", "voice", "revision")), pairs))


def test_fragment_fingerprint(spark):
    base = fingerprint(spark)
    assert base == "a41e3631cb1752874c11b19f30dd3b57"
    payload = {"text": "Ocean falował pod stacją.", "language": "pl", "model": "xtts-v2@abc123", "voice": "michal", "voice_revision": "deadbeef", "settings": {"temperature": 0.7, "speed": 1.0}, "renderer": 1}
    assert base == hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]
    assert fingerprint(spark, settings={"speed": 1, "temperature": 0.7}) == base
    for change in ({"text": "Ocean"}, {"language": "en"}, {"voice": "anna"}, {"revision": "x"}, {"model": "m"}, {"settings": {"speed": 1.1, "temperature": 0.7}}):
        assert fingerprint(spark, **change) != base


def test_pairs_digest(spark):
    pairs = F.array(*(F.struct(F.lit(a).alias("id"), F.lit(b).alias("fingerprint")) for a, b in (("b", "y"), ("a", "x"))))
    assert one(spark, identity.pairs_digest(pairs)) == "3c0b5eee5bd3bce6898141bcdfca2af0"


def test_strings_as_json(spark):
    for value in ('a"b\\c', "tab\tline\n", "zażółć 𝄞", ""):
        assert one(spark, identity.json_string(F.lit(value))) == json.dumps(value, ensure_ascii=False)


def test_other_identities(spark):
    files = F.array(F.struct(F.lit("v.json").alias("name"), F.lit(b"{}").alias("content")))
    assert one(spark, identity.voice_revision(files)) == hashlib.sha256(b"v.json{}").hexdigest()[:32]
    assert one(spark, identity.model_identity(F.lit("m"), F.lit("r"))) == "m@r" and one(spark, identity.model_identity(F.lit("m"), F.lit(""))) == "m"
    key = hashlib.sha256(b"".join(p.encode() + b"\0" for p in ("t", "pl", "v", "r", "m", '{"speed": 1.0, "x": 0.5}'))).hexdigest()[:12]
    settings = F.create_map(F.lit("x"), F.lit(0.5), F.lit("speed"), F.lit(1.0))
    assert one(spark, identity.audition_key(F.lit("t"), F.lit("pl"), F.lit("v"), F.lit("r"), F.lit("m"), settings)) == key
    assert one(spark, identity.checkpoint_key(F.lit("finetuned"), F.lit("/m"), "s")) == "finetuned:/m" and one(spark, identity.checkpoint_key(F.lit("clone"), F.lit("/m"), "s")) == "stock:s"
