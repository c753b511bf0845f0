"""The versioned catalog as append-only tables.

Nothing is updated in place: each function returns the rows that a table should hold, or those to append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """SK-05: incoming rows whose key is new, the first of each in order; duplicates keep the first identity."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    return fresh.withColumn("_n", first).filter("_n = 1").drop("_n").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """SK-06: incoming rows in place of existing ones of the same key. incoming has each key once."""
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def merge_partial(existing: DataFrame, rendered: DataFrame, key: str, order: str) -> DataFrame:
    """SK-04: a partial run's rows replace those of the same id; others stay and extras are added, in order."""
    values = [c for c in existing.columns if c != key]
    new = rendered.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_new"))
    joined = existing.join(new, key, "full_outer")
    return joined.select(key, *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values)).orderBy(order)


def content_addressed(files: DataFrame) -> DataFrame:
    """SK-07: one row of each content, the first path standing for it, with how many paths share it."""
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"))


def damaged(assets: DataFrame, content: str = "content") -> DataFrame:
    """SK-08: assets whose bytes no longer have their name."""
    return assets.filter(F.sha2(content, 256) != F.col("sha256"))


def restored_status(status: Column) -> Column:
    """SK-08: after a restore, what was in flight starts again or counts as interrupted."""
    return F.when(status.isin("claimed", "running"), "pending").when(status == "rendering", "interrupted").otherwise(status)


def newest_run(books: DataFrame, runs: DataFrame) -> DataFrame:
    """JN-07: of each book (slug, current_text_id) the newest run of that text."""
    joined = books.join(runs, books["current_text_id"] == runs["text_id"])
    return joined.groupBy("slug").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.max("created_at").alias("created_at"))


def books_with_text(books: DataFrame, texts: DataFrame) -> DataFrame:
    """JN-08: all books with what is known of their current text, if they have one."""
    return books.join(texts.withColumnRenamed("id", "current_text_id"), "current_text_id", "left").orderBy("slug")


def run_fragments(fragments: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """JN-09: a run's fragments with their chunk and the asset that holds their audio."""
    return fragments.join(chunks, "chunk_id").join(assets, "asset_id")


def findings_page(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN-10: findings with role and audio flag of their chunk, the worst first."""
    rows = findings.join(chunks.select("id", "role", F.col("audio_path").isNotNull().alias("has_audio")), "id", "left")
    return rows.withColumn("has_audio", F.coalesce("has_audio", F.lit(False))).orderBy(F.col("wer").desc(), "id")


# How well a model is validated, from none to best.
VALIDATION = ("unvalidated", "baseline", "validated")


def eligible_models(models: DataFrame, languages: DataFrame) -> DataFrame:
    """JN-11: for each language the models that narrate it, the best validated first."""
    rank = F.array_position(F.array(*(F.lit(v) for v in VALIDATION)), F.col("validation"))
    pairs = models.select("id", "validation", F.explode("narration_languages").alias("language")).join(languages, "language")
    place = F.row_number().over(Window.partitionBy("language").orderBy(rank.desc(), "id"))
    return pairs.select("language", "id", "validation", place.alias("place"))


def resolve_model(requests: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """JN-12: requests (id, language, override) -> model; one that cannot narrate the language stops the job."""
    wanted = F.when(F.coalesce("override", F.lit("")) != "", F.col("override")).otherwise(default)
    known = models.select(F.col("id").alias("model"), "narration_languages")
    rows = requests.withColumn("model", wanted).join(known, "model", "left")
    ok = F.coalesce(F.array_contains("narration_languages", F.col("language")), F.lit(False))
    said = F.concat_ws(" ", F.col("model"), F.lit("does not narrate"), F.col("language"))
    return rows.withColumn("model", F.when(ok, F.col("model")).otherwise(F.raise_error(said))).drop("narration_languages")


def sweep(assets: DataFrame, orphans: DataFrame, key: str, size: str) -> DataFrame:
    """RM-02: how many assets nothing refers to, and the bytes they hold."""
    return orphans.join(assets.select(key, F.col(size).alias("_bytes")), key).agg(F.count(F.lit(1)).alias("assets"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes_freed"))


def forget(tables: dict[str, DataFrame], runs: DataFrame, key: str = "run_id", busy: tuple[str, ...] = ("running", "queued"), force: bool = False) -> dict[str, DataFrame]:
    """RM-01: every table without the rows of the given runs; runs that are busy stay unless forced."""
    gone = runs if force else runs.filter(~F.col("status").isin(*busy))
    return {name: frame.join(gone.select(key), key, "left_anti") for name, frame in tables.items()}


def archivable(rendered: DataFrame, plan: DataFrame) -> DataFrame:
    """RM-03: books whose every rendered text is the planned one."""
    differs = rendered.join(plan.select("id", F.col("text").alias("planned")), "id", "left").filter(~F.col("text").eqNullSafe(F.col("planned")))
    return rendered.select("book").distinct().join(differs.select("book"), "book", "left_anti")


def attach_plan(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """RM-04: runs without a plan get the first plan of their text; one that has a plan keeps it."""
    first = plans.groupBy("text_id").agg(F.min_by("plan_id", F.struct("created_at", "plan_id")).alias("first_plan"))
    return runs.join(first, "text_id", "left").withColumn("plan_id", F.coalesce("plan_id", "first_plan")).drop("first_plan")


def foreign_key_problems(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """RM-06: children whose reference names no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
