"""Reports: aggregates over fragments, findings and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import quality
from folio.functions.identity import pairs_digest
from folio.functions.text import parse_bitrate

# Disk headroom, samples of two bytes, and the bounds of training segments.
HEADROOM, BYTES_PER_SAMPLE, SAMPLE_RATE, RESERVE = 1.25, 2, 24_000, 512 * 1024 * 1024
MIN_SEGMENT, MAX_SEGMENT, MIN_SEGMENT_CHARS, REFERENCES = 1.5, 15.0, 6, 12
SYSTEMIC_FAILURES = 5


def render_report(fragments: DataFrame, group: str) -> DataFrame:
    """AG-03: fragments (outcome: rendered, skipped or failed; audio_sec, elapsed_sec)."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    out = fragments.groupBy(group).agg(F.count(F.lit(1)).alias("total"), n("rendered").alias("rendered"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.sum("audio_sec").alias("audio_sec"), F.sum("elapsed_sec").alias("elapsed_sec"))
    factor = F.when(F.col("elapsed_sec") > 0, F.round(F.col("audio_sec") / F.col("elapsed_sec"), 2)).otherwise(0.0)
    return out.withColumn("ok", (F.col("failed") == 0) & (F.col("rendered") + F.col("skipped") == F.col("total"))).withColumn("realtime", factor)


def percent(done: Column, total: Column) -> Column:
    """AG-04."""
    return F.when(total > 0, F.bround(done * 100 / total, 1)).otherwise(0.0)


def eta_seconds(total: Column, done: Column, rendered: Column, elapsed: Column) -> Column:
    """AG-04: from what was rendered; skipped fragments took no time."""
    left = total - done
    return F.when((rendered > 0) & (elapsed > 0) & (left > 0), F.bround(left * (elapsed / rendered), 1)).otherwise(0.0)


def qa_report(findings: DataFrame, group: str, sample: int = 1, override: float = 0.0) -> DataFrame:
    """AG-05: findings (language, wer, missing): missing audio counts as all wrong."""
    wer = F.when(F.col("missing"), 1.0).otherwise(F.col("wer"))
    above = wer > quality.wer_threshold(F.col("language"), override)
    out = findings.groupBy(group).agg(F.count(F.lit(1)).alias("checked"), F.round(F.avg(wer), 4).alias("mean_wer"), F.count_if(above).alias("flagged"), F.count_if(F.col("missing")).alias("missing"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))
    return out.withColumn("ok", F.col("flagged") == 0).withColumn("full", F.lit(sample == 1))


def audio_digest(fragments: DataFrame, group: str) -> DataFrame:
    """AG-06: identity of a set of rendered fragments (id, fingerprint)."""
    pairs = F.collect_list(F.struct("id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint")))
    return fragments.groupBy(group).agg(pairs_digest(pairs).alias("digest"))


def benchmark_report(generations: DataFrame) -> DataFrame:
    """AG-07: by model and category, never over categories: generated, speed of those, failed, silent or short."""
    ok = F.col("ok")
    speed = F.avg(F.when(ok & (F.col("realtime") > 0), F.col("realtime")))
    return generations.groupBy("model", "category").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("generated"), F.round(speed, 2).alias("realtime"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.col("silent") | F.col("short"))).alias("odd"))


def first_failures(generations: DataFrame, k: int = 3) -> DataFrame:
    """WN-07: the first failures of each model."""
    rank = F.row_number().over(Window.partitionBy("model").orderBy("passage", "repeat"))
    return generations.filter(~F.col("ok")).withColumn("rank", rank).filter(F.col("rank") <= k)


def disk_estimate(chunks: DataFrame, rendered: DataFrame, group: str, rate: int = SAMPLE_RATE, bitrate: str = "64k") -> DataFrame:
    """AG-09: bytes needed to narrate what is missing and to assemble the whole."""
    done = rendered.select("id", F.lit(True).alias("_done")).distinct()
    left = F.sum(F.when(F.col("_done").isNull(), F.col("est_seconds")).otherwise(0.0))
    out = chunks.join(done, "id", "left").groupBy(group).agg(F.sum("est_seconds").alias("total_seconds"), left.alias("remaining_seconds"))
    synth = F.floor(F.col("remaining_seconds") * rate * BYTES_PER_SAMPLE * HEADROOM).cast("long")
    assembly = F.floor(F.col("total_seconds") * (parse_bitrate(F.lit(bitrate)) / 8) * HEADROOM).cast("long")
    return out.withColumn("synthesis_bytes", synth).withColumn("assembly_bytes", assembly)


def has_room(needed: Column, free: Column) -> Column:
    """AG-09: with a reserve left over."""
    return needed + RESERVE <= free


def language_groups(chunks: DataFrame, default: str = "pl") -> DataFrame:
    """AG-10."""
    return chunks.groupBy(F.coalesce(F.nullif("language", F.lit("")), F.lit(default)).alias("language")).agg(F.count(F.lit(1)).alias("chunks"))


def import_tally(results: DataFrame, group: str | None = None) -> DataFrame:
    """AG-11: files by what became of them."""
    keys = [group, "status"] if group else ["status"]
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))


def dataset_totals(segments: DataFrame, group: str) -> DataFrame:
    """AG-12: usable segments and their minutes."""
    usable = F.col("seconds").between(MIN_SEGMENT, MAX_SEGMENT) & (F.length("text") >= MIN_SEGMENT_CHARS)
    return segments.filter(usable).groupBy(group).agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("seconds") / 60, 2).alias("minutes"))


def dataset_references(segments: DataFrame, group: str, k: int = REFERENCES) -> DataFrame:
    """AG-12: the longest usable segments of each voice."""
    usable = segments.filter(F.col("seconds").between(MIN_SEGMENT, MAX_SEGMENT) & (F.length("text") >= MIN_SEGMENT_CHARS))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("seconds").desc(), "id"))
    return usable.withColumn("rank", rank).filter(F.col("rank") <= k)


def systemic_stop(results: DataFrame, group: str, order: str) -> DataFrame:
    """QA-10: the place at which a run should have stopped: five failures of one kind and nothing rendered before."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = results.select(
        group,
        order,
        F.count_if(F.col("outcome") == "failed").over(w).alias("failed"),
        F.count_if(F.col("outcome") == "rendered").over(w).alias("rendered"),
        F.min(F.when(F.col("outcome") == "failed", F.col("kind"))).over(w).alias("one"),
        F.max(F.when(F.col("outcome") == "failed", F.col("kind"))).over(w).alias("other"),
    )
    hit = rows.filter((F.col("failed") >= SYSTEMIC_FAILURES) & (F.col("rendered") == 0) & (F.col("one") == F.col("other")))
    return hit.groupBy(group).agg(F.min(order).alias("stopped_at"), F.min_by("one", order).alias("kind"))
