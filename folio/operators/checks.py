"""Consistency checks between a plan and what came of it.

All are equi joins and anti joins on identities; Catalyst picks their strategy by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stale_fragments(rendered: DataFrame, planned: DataFrame) -> DataFrame:
    """JN-01: rendered (id, fingerprint) whose plan (id, expected) is another now; blank or unplanned ones pass."""
    joined = rendered.filter(F.coalesce("fingerprint", F.lit("")) != "").join(planned.select("id", "expected"), "id")
    return joined.filter(F.col("fingerprint") != F.col("expected"))


def completeness_problems(rendered: DataFrame, planned: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """JN-02: (problem, id): ids rendered twice, planned but not rendered, rendered but not planned, without a file."""
    ids, plan = rendered.select("id"), planned.select("id")
    label = lambda df, name: df.select(F.lit(name).alias("problem"), "id")
    out = label(ids.groupBy("id").count().filter("count > 1"), "duplicate")
    out = out.unionByName(label(plan.join(ids, "id", "left_anti").distinct(), "missing"))
    out = out.unionByName(label(ids.join(plan, "id", "left_anti").distinct(), "unknown"))
    if files is not None:
        out = out.unionByName(label(rendered.join(files.select("audio_path"), "audio_path", "left_anti"), "no file"))
    return out


def ordering_problems(rendered: DataFrame, planned: DataFrame) -> DataFrame:
    """JN-03: ids whose position or chapter differs between render (id, order, chapter_index) and plan."""
    plan = planned.select("id", F.col("order").alias("planned_order"), F.col("chapter_index").alias("planned_chapter"))
    joined = rendered.select("id", "order", "chapter_index").join(plan, "id")
    moved = ~F.col("order").eqNullSafe(F.col("planned_order"))
    rechaptered = ~F.col("chapter_index").eqNullSafe(F.col("planned_chapter"))
    return joined.select("id", moved.alias("moved"), rechaptered.alias("rechaptered")).filter(F.col("moved") | F.col("rechaptered"))


def classify_sources(files: DataFrame, known: DataFrame) -> DataFrame:
    """JN-05: files (path, sha256, slug) of a scan against known books (slug, sha256, source): status, slug, duplicate_of.

    Same bytes as a known book: unchanged; as an earlier file of the scan: duplicate; from a known book's file:
    revised; else new. Earlier is by path."""
    by_bytes = known.filter(F.coalesce("sha256", F.lit("")) != "").groupBy("sha256").agg(F.min("slug").alias("same_slug"))
    by_path = known.filter(F.coalesce("source", F.lit("")) != "").groupBy(F.col("source").alias("path")).agg(F.min("slug").alias("path_slug"))
    first = F.min("path").over(Window.partitionBy("sha256"))
    rows = files.withColumn("first_path", first).join(by_bytes, "sha256", "left").join(by_path, "path", "left")
    duplicate = F.col("first_path") < F.col("path")
    status = F.when(F.col("same_slug").isNotNull(), "unchanged").when(duplicate, "duplicate").when(F.col("path_slug").isNotNull(), "revised").otherwise("new")
    slug = F.coalesce("same_slug", F.when(~duplicate, F.col("path_slug")), "slug")
    return rows.select("path", "sha256", slug.alias("slug"), status.alias("status"), F.when(status == "duplicate", F.col("first_path")).alias("duplicate_of"))


def unreferenced(assets: DataFrame, key: str, references: list[Column], tables: list[DataFrame]) -> DataFrame:
    """JN-06: assets that no reference column names; nulls name nothing."""
    used = None
    for column, frame in zip(references, tables):
        ids = frame.select(column.alias(key)).filter(F.col(key).isNotNull())
        used = ids if used is None else used.unionByName(ids)
    return assets.join(used.distinct(), key, "left_anti")


def already_imported(sources: DataFrame, current: DataFrame) -> DataFrame:
    """JN-14: sources whose bytes are those of a book's current revision."""
    return sources.join(current.select("sha256"), "sha256", "left_semi")


def verified_results(rendered: DataFrame, plan: DataFrame) -> DataFrame:
    """JN-15: results joined to their plan; a voice or fingerprint other than planned stops the job."""
    joined = rendered.join(plan.select("id", F.col("voice").alias("planned_voice"), F.col("fingerprint").alias("planned_fingerprint")), "id")
    same = F.col("voice").eqNullSafe(F.col("planned_voice")) & F.col("fingerprint").eqNullSafe(F.col("planned_fingerprint"))
    ok = F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("result differs from its plan: "), F.col("id"))).cast("boolean"))
    return joined.filter(ok).drop("planned_voice", "planned_fingerprint")


def latest_by_line(ledger: DataFrame, key: str, value: str, line: str) -> DataFrame:
    """SC-12: of each id the value of its last line."""
    return ledger.groupBy(key).agg(F.max_by(value, line).alias(value))


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """ST-03: each value once, at its first place."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """ST-01: values of a that b lacks, once each."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
