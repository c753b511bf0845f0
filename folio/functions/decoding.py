"""How bytes are read as text, with the evidence kept.

A wrong byte must cost its row and not the job, so candidates are decoded strictly in an Arrow function that
returns null where a table does not fit; the choice between them is native.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from folio.functions import text as tx
from folio.io import in_pieces

# The single-byte tables tried, and how close two scores count as equal.
LEGACY = ("cp1250", "iso-8859-2", "cp1252")
TIE_MARGIN, POOR_QUALITY = 0.05, 0.0
DECODED = "struct<text:string,encoding:string,method:string,score:double,equivalent:array<string>,warnings:array<string>,needs_review:boolean,reasons:array<string>,error:string>"


@arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """DC-04: composed normal form, without byte-order marks."""

    def composed(text: pa.Scalar) -> tuple[str | None, int]:
        t = text.as_py()
        return (None, 0) if t is None else (unicodedata.normalize("NFC", t.replace(tx.BOM, "")), len(t))

    return in_pieces(texts, composed, pa.string())


@arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def comparison_tokens(c: Column) -> Column:
    """TX-10 for text in any form."""
    return tx.comparison_tokens(nfkc(c))


def strict_decoder(encoding: str):
    """An Arrow function from bytes to text in the encoding; null where it does not fit."""

    def read(raw: pa.Scalar) -> tuple[str | None, int]:
        b = raw.as_py()
        try:
            return (None, 0) if b is None else (unicodedata.normalize("NFC", b.decode(encoding).replace(tx.BOM, "")), len(b))
        except (UnicodeDecodeError, LookupError):
            return None, 0

    @arrow_udf(T.StringType())
    def decode(raw: pa.Array) -> pa.Array:
        return in_pieces(raw, read, pa.string())

    return decode


@arrow_udf(T.ArrayType(T.StringType()))
def detector_ranking(raw: pa.Array) -> pa.Array:
    """DC-06: encodings that a statistical detector finds plausible, the best first; none without the detector."""
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return pa.array([[]] * len(raw), pa.list_(pa.string()))
    return pa.array([[] if b is None else [m.encoding.replace("_", "-") for m in from_bytes(b) if m.encoding] for b in raw.to_pylist()], pa.list_(pa.string()))


def _decision(text, encoding, method, score, equivalent=None, warnings=None, review=None, reasons=None, error=None) -> Column:
    none = F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    values = (text, encoding, method, score, equivalent, warnings, review, reasons, error)
    defaults = (null, null, F.lit(""), F.lit(0.0), none, none, F.lit(False), none, null)
    names = ("text", "encoding", "method", "score", "equivalent", "warnings", "needs_review", "reasons", "error")
    return F.struct(*((d if v is None else v).alias(n) for v, d, n in zip(values, defaults, names))).cast(DECODED)


def decode(files: DataFrame, raw: str = "content", override: str = "") -> DataFrame:
    """DC-02: files with a struct `decoded`: an override or nothing, else the mark, else UTF-8, else the best legacy table.

    A legacy reading is left for review if one that scores as well gives another text, or if the best is poor."""
    content = F.col(raw)
    mark = tx.bom_encoding(content)
    rows = files.withColumn("_bom", mark)
    if override:
        rows = rows.withColumn("_text", strict_decoder(override)(content))
        family = tx.encoding_family(F.lit(override))
        clash = F.col("_bom").isNotNull() & (tx.encoding_family(F.col("_bom")) != family)
        warnings = F.when(clash, F.array(F.concat(F.lit("mark says "), F.col("_bom")))).otherwise(F.array().cast("array<string>"))
        good = _decision(F.col("_text"), F.lit(override), F.lit("override"), F.lit(0.0), warnings=warnings)
        bad = _decision(None, None, None, None, error=F.lit(f"not valid {override}"))
        return rows.withColumn("decoded", F.when(F.col("_text").isNotNull(), good).otherwise(bad)).drop("_bom", "_text")
    marked = F.coalesce(*(F.when(F.col("_bom") == e, strict_decoder(e)(F.when(F.col("_bom") == e, content))) for e in ("utf-8-sig", "utf-16", "utf-32")))
    is_ascii = ~content.cast("string").rlike(r"[^\x00-\x7F]")
    # ASCII is its own composed form: only what lies beyond goes to Python
    utf8 = F.when(is_ascii, content.cast("string")).otherwise(nfc(F.when(~is_ascii & F.is_valid_utf8(content.cast("string")), content.cast("string"))))
    rows = rows.withColumn("_marked", marked).withColumn("_utf8", utf8)
    legacy = F.col("_marked").isNull() & F.col("_utf8").isNull()
    rows = rows.withColumns({f"_{k}": strict_decoder(e)(F.when(legacy, content)) for k, e in enumerate(LEGACY)})
    rows = rows.withColumn("_rank", detector_ranking(F.when(legacy, content)))
    place = lambda e: F.when(F.array_position("_rank", e) > 0, F.array_position("_rank", e)).otherwise(99)
    one = lambda k, e: F.when(F.col(f"_{k}").isNotNull(), F.struct((-tx.text_quality(F.col(f"_{k}"))).alias("cost"), place(e).alias("rank"), F.lit(k).alias("k"), F.lit(e).alias("encoding"), F.col(f"_{k}").alias("text")))
    ranked = F.array_sort(F.filter(F.array(*(one(k, e) for k, e in enumerate(LEGACY))), lambda x: x.isNotNull()))
    rows = rows.withColumn("_c", ranked)
    best = F.col("_c")[0]
    rivals = F.filter("_c", lambda x: (x["cost"] - best["cost"] <= TIE_MARGIN) & (x["text"] != best["text"]))
    same = F.transform(F.filter("_c", lambda x: x["text"] == best["text"]), lambda x: x["encoding"])
    reasons = F.filter(F.array(F.when(F.size(rivals) > 0, "another table reads as well"), F.when(-best["cost"] < POOR_QUALITY, "poor text")), lambda x: x.isNotNull())
    warnings = F.when(F.col("_bom").isNotNull(), F.array(F.concat(F.lit("mark says "), F.col("_bom")))).otherwise(F.array().cast("array<string>"))
    plain = F.when(is_ascii, _decision(F.col("_utf8"), F.lit("utf-8"), F.lit("ascii"), None, equivalent=F.array(F.lit("utf-8"), *(F.lit(e) for e in LEGACY)), warnings=warnings)).otherwise(_decision(F.col("_utf8"), F.lit("utf-8"), F.lit("utf-8"), None, warnings=warnings))
    chosen = _decision(best["text"], best["encoding"], F.lit("quality"), -best["cost"], equivalent=same, warnings=warnings, review=F.size(reasons) > 0, reasons=reasons)
    none = _decision(None, None, None, None, warnings=warnings, error=F.lit("no table reads it"))
    decision = F.when(F.col("_marked").isNotNull(), _decision(F.col("_marked"), F.col("_bom"), F.lit("bom"), None)).when(F.col("_utf8").isNotNull(), plain).when(F.size("_c") > 0, chosen).otherwise(none)
    return rows.withColumn("decoded", decision).drop("_bom", "_marked", "_utf8", "_rank", "_c", *(f"_{k}" for k in range(len(LEGACY))))
