"""Content identities: digests over canonical JSON, byte for byte.

Two conventions exist and must not be mixed: fingerprints are compact JSON with letters kept as they are; the
digest of rendered fragments is JSON with blanks after separators and everything beyond ASCII escaped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_CHARS, KEY_CHARS, RENDERER_VERSION = 32, 12, 1
#: Control characters whose escapes have letters, which Spark writes large and the digests have small.
_LETTERED = ("0b", "0e", "0f", "1a", "1b", "1c", "1d", "1e", "1f")


def json_string(c: Column) -> Column:
    """A JSON string with only what must be escaped escaped; letters beyond ASCII stay."""
    quoted = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    lower = quoted
    for code in _LETTERED:  # but not what follows an escaped backslash
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00{code.upper()}", rf"$1\\u00{code}")
    quoted = F.when(c.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), lower).otherwise(quoted)
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def json_float(c: Column) -> Column:
    """A double as JSON writes it, for magnitudes from 1e-3 to 1e7."""
    return c.cast("double").cast("string")


def json_floats(settings: Column) -> Column:
    """A map<string,double> as compact JSON, keys in order."""
    entries = F.array_sort(F.map_entries(settings))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_float(e["value"]))), ","), F.lit("}"))


def json_object(**fields: Column) -> Column:
    """Compact JSON of fields that are JSON already, keys in order."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def digest(json: Column, chars: int = DIGEST_CHARS) -> Column:
    """FP-03: the beginning of the SHA-256 of a JSON text."""
    return F.substring(F.sha2(json, 256), 1, chars)


def fragment_fingerprint(text: Column, language: Column, model: Column, voice: Column, revision: Column, settings: Column, renderer: int = RENDERER_VERSION) -> Column:
    """FP-01: changes exactly if something does that would change the audio."""
    return digest(
        json_object(
            text=json_string(text),
            language=json_string(language),
            model=json_string(model),
            voice=json_string(voice),
            voice_revision=json_string(revision),
            settings=json_floats(settings),
            renderer=F.lit(str(renderer)),
        )
    )


def voice_revision(files: Column) -> Column:
    """FP-02: over names and contents of array<struct<name,content>>, in the array's order; absent files are left out."""
    joined = F.aggregate(files, F.lit(b""), lambda acc, f: F.concat(acc, F.encode(f["name"], "UTF-8"), f["content"]))
    return F.substring(F.sha2(joined, 256), 1, DIGEST_CHARS)


def audition_key(text: Column, language: Column, voice: Column, revision: Column, model: Column, settings: Column) -> Column:
    """FP-04: parts closed by NUL; settings as JSON with blanks after separators."""
    entries = F.array_sort(F.map_entries(settings))
    spaced = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_float(e["value"]))), ", "), F.lit("}"))
    parts = [F.concat(F.encode(p, "UTF-8"), F.lit(b"\0")) for p in (text, language, voice, revision, model, spaced)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, KEY_CHARS)


def model_identity(model_id: Column, revision: Column) -> Column:
    """FP-05: the revision only where one is pinned."""
    return F.when(F.coalesce(revision, F.lit("")) != "", F.concat(model_id, F.lit("@"), revision)).otherwise(model_id)


def conditioning_key(engine: Column, name: Column, content: Column) -> Column:
    """FP-06: of a voice's conditioning from its reference clip."""
    return F.substring(F.sha2(F.concat(F.encode(engine, "UTF-8"), F.encode(name, "UTF-8"), content), 256), 1, DIGEST_CHARS)


def checkpoint_key(mode: Column, model_dir: Column, stock: str) -> Column:
    """FP-06: of a loaded checkpoint."""
    tuned = (mode == "finetuned") & (F.coalesce(model_dir, F.lit("")) != "")
    return F.when(tuned, F.concat(F.lit("finetuned:"), model_dir)).otherwise(F.lit(f"stock:{stock}"))


def pairs_digest(pairs: Column) -> Column:
    """AG-06: of array<struct<id,fingerprint>> with ASCII ids, in order of both, as JSON with blanks after separators."""
    each = F.transform(F.array_sort(pairs), lambda p: F.concat(F.lit("["), json_string(p["id"]), F.lit(", "), json_string(p["fingerprint"]), F.lit("]")))
    return digest(F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]")))
