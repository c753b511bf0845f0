"""Manifests, ledgers, configuration and datasets."""

from __future__ import annotations

import json
import tomllib
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Version and fields of the stored forms.
SCHEMA_VERSION = 7
SUBSTITUTIONS = "array<struct<kind:string,source:string,spoken:string,start:int,end:int,spoken_start:int,spoken_end:int>>"
CHUNK = f"id string, chapter_index int, chapter_title string, `order` int, text string, source_text string, substitutions {SUBSTITUTIONS}, kind string, language string, role string, is_dialogue boolean, pause_after_ms int, chars int, est_seconds double, source_ref string, audio_path string, duration_sec double, voice string, fingerprint string"
LEDGER = "id string, fingerprint string"
ENGINES, CLONING, LEVELS = ("xtts", "chatterbox"), ("latents", "reference"), ("unvalidated", "baseline", "validated")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line")).filter(F.trim("line") != "")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """SC-10: a chunk manifest; an unknown field or a value of another type stops the job and says the line."""
    schema = T._parse_datatype_string(CHUNK)
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    rows = _lines(spark, path).withColumn("extra", F.array_except(F.json_object_keys("line"), known))
    bad = F.concat(F.lit("unknown field in: "), F.col("line"))
    checked = rows.withColumn("line", F.when(F.coalesce(F.size("extra"), F.lit(0)) <= 0, F.col("line")).otherwise(F.raise_error(bad)))
    return checked.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC-11: a file of JSON lines without those that are torn or wrong."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC-11: a file of JSON lines of which each must be right."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """SC-12: of each id the fingerprint written last: in a folder that of the last file by name, in a file the last by
    place. A file may be read in several splits: rows of one split go up in a task, and splits go by where they begin."""
    text = spark.read.text(path).select(F.col("value").alias("line"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("place"))
    rows = text.filter(F.trim("line") != "")
    parsed = rows.select("place", F.from_json("line", LEDGER).alias("r")).filter("r.id IS NOT NULL")
    return parsed.groupBy("r.id").agg(F.max_by("r.fingerprint", "place").alias("fingerprint"))


def read_cast(path: str) -> dict[str, str]:
    """SC-13: role to voice; a wrong shape raises."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    roles = raw.get("roles", raw) if isinstance(raw, dict) else None
    if not isinstance(roles, dict):
        raise ValueError(f"{path} is no mapping of roles")
    return {str(k): str(v["voice"] if isinstance(v, dict) else v) for k, v in roles.items()}


def read_dictionary(path: str) -> dict[str, str]:
    """SC-13: written to spoken form; a missing file is empty, a wrong shape raises."""
    import yaml

    try:
        entries = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        entries = None
    match entries or {}:
        case dict() as found:
            return dict(map(lambda pair: (str(pair[0]), str(pair[1])), found.items()))
    raise ValueError(f"{path} is no mapping of written to spoken forms")


def read_overrides(path: str) -> dict[str, str]:
    """SC-13: source_ref to role; anything damaged is empty."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return {str(k): str(v) for k, v in raw.items() if v} if isinstance(raw, dict) else {}


def read_registry(path: str) -> tuple[list[dict], str]:
    """SC-14: models of a registry and the default's id; entries that contradict themselves raise."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    models, default = [], raw.get("default", "")
    for model_id, entry in (raw.get("models") or {}).items():
        problems = [what for what, bad in (("engine", entry.get("engine") not in ENGINES), ("cloning", entry.get("cloning", CLONING[0]) not in CLONING), ("validation", entry.get("validation", LEVELS[0]) not in LEVELS), ("narration languages", not entry.get("narration_languages"))) if bad]
        controls, pins = list(entry.get("controls", [])), dict(entry.get("settings", {}))
        problems += [f"setting {k}" for k in pins if k not in controls]
        if problems:
            raise ValueError(f"{path}: {model_id}: {', '.join(problems)}")
        models.append({"id": model_id, "engine": entry["engine"], "environment": entry.get("environment", ""), "revision": entry.get("revision", ""), "narration_languages": list(entry["narration_languages"]), "controls": controls, "settings": {k: float(v) for k, v in pins.items()}, "char_limits": {k: int(v) for k, v in entry.get("char_limits", {}).items()}, "default_char_limit": int(entry.get("default_char_limit", 250)), "validation": entry.get("validation", LEVELS[0])})
    if default and default not in {m["id"] for m in models}:
        raise ValueError(f"{path}: the default {default} is no model")
    return models, default


MODELS = "id string, engine string, environment string, revision string, narration_languages array<string>, controls array<string>, settings map<string,double>, char_limits map<string,int>, default_char_limit int, validation string"


def models_table(spark: SparkSession, models: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(m[f.split(" ")[0]] for f in MODELS.split(", ")) for m in models], MODELS)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SC-15: passages (id, category, text)."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    rows = raw.get("passages") or raw.get("passage") or []
    return spark.createDataFrame([(str(p["id"]), str(p.get("category", "")), str(p["text"])) for p in rows], "id string, category string, text string")


def read_dataset(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """SC-16: `filename|text` lines whose file is there; text may hold bars."""
    rows = spark.read.text(path).filter(F.col("value").contains("|"))
    parts = F.split("value", r"\|", 2)
    return rows.select(F.trim(parts[0]).alias("filename"), F.trim(parts[1]).alias("text")).filter("filename <> ''").join(files.select("filename"), "filename", "left_semi")


def book_view(meta: DataFrame, reports: DataFrame, progress: DataFrame, outputs: DataFrame, qa: DataFrame | None = None) -> DataFrame:
    """SC-17: books with what is known of each; a list leaves the quality report out."""
    n = outputs.groupBy("slug").agg(F.count(F.lit(1)).alias("outputs"))
    rows = meta.join(reports, "slug", "left").join(progress, "slug", "left").join(n, "slug", "left")
    return rows.join(qa, "slug", "left") if qa is not None else rows


def publish_text(path: str, content: str) -> str:
    """SK-01: a small file on the driver's file system, whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        staged.write_text(content, encoding="utf-8")
        staged.replace(target)
    finally:
        staged.unlink(missing_ok=True)
    return path


def write_manifest(plan: DataFrame, meta: DataFrame, folder: str) -> None:
    """SK-02: chunks by book as JSON lines, and one meta row for each book; each table commits as a whole."""
    plan.write.mode("overwrite").partitionBy("book").json(f"{folder}/chunks")
    meta.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").json(f"{folder}/books")


def append_ledger(rows: DataFrame, folder: str) -> None:
    """SK-03: what was rendered, behind what is there."""
    rows.select("id", "fingerprint").write.mode("append").json(folder)


def schema_drift(stored: dict[str, str], current: dict[str, str]) -> list[str]:
    """SK-09: stored forms that differ from the current ones, are missing, or are no longer used."""
    return sorted({k for k in current if stored.get(k) != current[k]} | (stored.keys() - current.keys()))


def schemas() -> dict[str, str]:
    """SK-09: the stored forms as JSON."""
    return {f"chunk_v{SCHEMA_VERSION}": T._parse_datatype_string(CHUNK).json(), f"ledger_v{SCHEMA_VERSION}": T._parse_datatype_string(LEDGER).json()}


def dry_run(plan: DataFrame, voices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SK-10: durations a silent render would have, and the voices it would miss."""
    silent = plan.withColumn("duration_sec", F.round(F.greatest("est_seconds", F.lit(0.2)), 3))
    return silent, plan.select("voice").distinct().join(voices.select("voice"), "voice", "left_anti")
