"""Ordered loops as windows, sorts and top-k."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SILENCE_DBFS, SILENCE_SAMPLE = -60.0, 12
PASSAGE_MIN_CHARS, PASSAGE_MAX_CHARS = 120, 600


def chapter_marks(fragments: DataFrame, book: str = "book") -> DataFrame:
    """WN-01: a mark at every change of chapter in playing order: (book, chapter_index, start, end) in seconds.

    fragments (book, order, chapter_index, duration_sec, pause_after_ms). The clock runs within a book."""
    w = Window.partitionBy(book).orderBy("order")
    length = F.col("duration_sec") + F.col("pause_after_ms") / 1000
    clock = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(length).over(Window.partitionBy(book))
    before = F.lag("chapter_index").over(w)
    rows = fragments.select(book, "order", "chapter_index", clock.alias("start"), total.alias("total"), (F.row_number().over(w) == 1).alias("head"), before.eqNullSafe(F.col("chapter_index")).alias("same"))
    marks = rows.filter(F.col("head") | ~F.col("same"))
    end = F.coalesce(F.lead("start").over(w), F.col("total"))
    return marks.select(book, "order", "chapter_index", "start", end.alias("end"))


def assign_positions(new: DataFrame, existing: DataFrame, group: str, order: str, position: str = "position") -> DataFrame:
    """WN-02: new rows get the positions after the highest one of their group, from 0 in a new group."""
    highest = existing.groupBy(group).agg(F.max(position).alias("highest"))
    offset = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return new.join(highest, group, "left").withColumn(position, F.coalesce("highest", F.lit(-1)) + offset).drop("highest")


def median_passage(chunks: DataFrame, role: str = "", book: str = "book") -> DataFrame:
    """WN-03: of each book the middle passage: of the role if it has any, then of a speakable length if any is."""
    preferred = F.col("role") == role if role else F.lit(True)
    any_role = F.max(preferred.cast("int")).over(Window.partitionBy(book)) == 1
    wanted = chunks.withColumn("_preferred", preferred).withColumn("_any", any_role).filter(F.col("_preferred") | ~F.col("_any"))
    sized = F.length("text").between(PASSAGE_MIN_CHARS, PASSAGE_MAX_CHARS)
    wanted = wanted.withColumn("_sized", sized).withColumn("_any_sized", F.max(sized.cast("int")).over(Window.partitionBy(book)) == 1)
    pool = wanted.filter(F.col("_sized") | ~F.col("_any_sized"))
    w = Window.partitionBy(book)
    at, n = F.row_number().over(w.orderBy("order")) - 1, F.count(F.lit(1)).over(w)
    middle = pool.withColumn("_at", at).withColumn("_n", n).filter(F.col("_at") == F.floor(F.col("_n") / 2))
    return middle.drop("_preferred", "_any", "_sized", "_any_sized", "_at", "_n")


def every_nth(rows: DataFrame, group: str, order: str, n: int, limit: int = 0) -> DataFrame:
    """WN-04: every n-th row of a group, the first included, up to a limit."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    picked = rows.withColumn("_at", at).filter(F.col("_at") % n == 0)
    if limit:
        picked = picked.filter(F.col("_at") < n * limit)
    return picked.drop("_at")


def stride_sample(rows: DataFrame, group: str, order: str, most: int = SILENCE_SAMPLE) -> DataFrame:
    """AG-08: at most `most` rows of a group, evenly apart."""
    w = Window.partitionBy(group)
    at, n = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    picked = rows.withColumn("_at", at).withColumn("_n", n).filter((F.col("_at") % step == 0) & (F.col("_at") < step * most))
    return picked.drop("_at", "_n")


def all_silent(peaks: DataFrame, group: str, order: str, peak: str = "peak_dbfs") -> DataFrame:
    """AG-08: whether every sampled fragment of a group is silence; unmeasured ones do not count."""
    sample = stride_sample(peaks, group, order)
    return sample.groupBy(group).agg(F.coalesce(F.bool_and(F.col(peak) <= SILENCE_DBFS), F.lit(False)).alias("all_silent"))


def reference_clip(clips: DataFrame, group: str) -> DataFrame:
    """WN-05: of each voice the largest clip, of equal ones the first path."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.col("bytes").desc(), "path"))
    return clips.withColumn("_n", first).filter("_n = 1").drop("_n")


def page(rows: DataFrame, order: list, limit: int = 0, offset: int = 0) -> DataFrame:
    """WN-06: a page of rows in order; limit 0 is no limit."""
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def listed(ids: Column, shown: int = 5) -> Column:
    """WN-07: the first few of an array of ids in order, and how many more."""
    ordered = F.array_sort(ids)
    rest = F.size(ordered) - shown
    text = F.array_join(F.slice(ordered, 1, shown), ", ")
    return F.when(rest > 0, F.concat(text, F.format_string(" and %d more", rest))).otherwise(text)


def first_k(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """WN-07: the first k rows of each group; the limit is pushed below the exchange."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def expired(jobs: DataFrame, group: str, keep: int = 20) -> DataFrame:
    """WN-08: finished jobs beyond the newest `keep`; running ones never."""
    done = jobs.filter(F.col("status") != "running")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("created_at").desc(), F.col("id").desc()))
    return done.withColumn("rank", rank).filter(F.col("rank") > keep)


def unique_slugs(rows: DataFrame, base: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """WN-09: `base`, `base-2`, `base-3`... in order, never one that is taken or was given earlier.

    Names interact only within a family, the base without trailing numbers, so each family is numbered on its own
    by a loop over sorted rows that holds the names given and not the rows."""
    stem = lambda c: F.regexp_replace(c, r"(-[0-9]+)+$", "")
    now = rows.select(F.col(base).alias("base"), F.col(order).alias("at"), F.lit(1).alias("kind"))
    if taken is not None:
        now = now.unionByName(taken.select(F.col(base).alias("base"), F.lit(None).alias("at"), F.lit(0).alias("kind")))
    at_type = rows.schema[order].dataType.simpleString()
    family = stem(F.col("base")).alias("family")

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used, following = None, set(), {}
        for frame in frames:
            out = []
            for fam, name, at, kind in zip(frame["family"], frame["base"], frame["at"], frame["kind"]):
                if fam != last:
                    last, used, following = fam, set(), {}
                if kind == 0:
                    used.add(name)
                    continue
                slug, k = name, following.get(name, 2)
                while slug in used:
                    slug, k = f"{name}-{k}", k + 1
                following[name] = k
                used.add(slug)
                out.append((at, name, slug))
            yield pd.DataFrame(out, columns=[order, base, "slug"])

    dealt = now.select(family, "base", "at", "kind").repartition("family").sortWithinPartitions("family", "kind", "at")
    return dealt.mapInPandas(number, f"`{order}` {at_type}, `{base}` string, slug string")
