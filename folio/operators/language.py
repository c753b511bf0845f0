"""Which language a book is in, decided by its own text or left open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import language_code, let

# Sizes and thresholds of the decision, and the languages that can be narrated.
MIN_SAMPLE_CHARS, MIN_TOTAL_CHARS, MIN_CONFIDENCE, SAMPLES, MIN_PARAGRAPH = 200, 400, 0.65, 5, 40
SUPPORTED = ("pl", "en")

#: Function words that stand for a language; those of more languages count for each.
FUNCTION_WORDS = {
    "pl": "i w na się nie z do to że jest jak po co ale od czy tak był była przez",
    "en": "the of and to in is that it was for with as his on be at by not this are",
    "de": "der die das und ist nicht ein eine zu den mit sich auf für von dem sie auch als im",
    "fr": "le la les de des et est un une que qui dans pour pas sur au avec ce elle du",
    "es": "el la los de y que en un una es no se por con para las del su lo como",
}


def classify(text: Column) -> Column:
    """LG-01: struct<language, confidence>: the language of most function words and its share among all hits.

    A stand-in that needs no model: short or wordless text has no language and confidence 0."""
    listed = sorted({w for words in FUNCTION_WORDS.values() for w in words.split(" ")})
    tokens = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w]+", " ")), " ")

    def decide_(hits: Column) -> Column:
        best, total = F.greatest(*(hits[c] for c in FUNCTION_WORDS)), sum((hits[c] for c in FUNCTION_WORDS), F.lit(0))
        name = F.coalesce(*(F.when(hits[code] == best, code) for code in sorted(FUNCTION_WORDS)))
        return F.struct(F.when(total > 0, name).otherwise("").alias("language"), F.when(total > 0, F.round(best / total, 4)).otherwise(0.0).alias("confidence"))

    def count(found: Column) -> Column:
        hits = lambda words: F.size(F.filter(found, lambda x: x.isin(words.split(" "))))
        return let(F.struct(*(hits(words).alias(code) for code, words in FUNCTION_WORDS.items())), decide_)

    # one pass over the text for all words, then short arrays
    return let(F.filter(tokens, lambda x: x.isin(listed)), count)


def gather_samples(chapters: DataFrame) -> DataFrame:
    """LG-02: (book, chapter, source_ref, paragraphs) -> at most five passages of each book: (book, place, sample).

    The first, the last and evenly spaced chapters; a book without a chapter long enough is one passage."""
    long_ones = F.array_join(F.filter("paragraphs", lambda p: F.length(p) > MIN_PARAGRAPH), " ")
    bodies = chapters.select("book", "chapter", "source_ref", long_ones.alias("body"), "paragraphs")
    usable = bodies.filter(F.length("body") >= MIN_SAMPLE_CHARS)
    w = Window.partitionBy("book")
    placed = usable.select("book", F.col("source_ref").alias("place"), F.substring("body", 1, MIN_SAMPLE_CHARS * 5).alias("sample"), (F.row_number().over(w.orderBy("chapter")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    middles = [F.col("i") == F.floor(F.lit(k) * (F.col("n") / (SAMPLES - 1))) for k in range(1, SAMPLES - 1)]
    wanted = (F.col("n") <= SAMPLES) | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    for m in middles:
        wanted = wanted | m
    picked = placed.filter(wanted).select("book", "place", "sample")
    # books without any such chapter, as one passage
    short = bodies.join(usable.select("book").distinct(), "book", "left_anti")
    whole = short.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", "paragraphs"))).alias("all"))
    whole = whole.select("book", F.lit("whole book").alias("place"), F.array_join(F.flatten(F.transform("all", lambda c: c["paragraphs"])), " ").alias("sample"))
    return picked.unionByName(whole.filter("sample <> ''"))


def decide(samples: DataFrame, books: DataFrame) -> DataFrame:
    """LG-03: samples (book, chars, language, confidence) and books (book, metadata_language, override) -> a decision.

    Text is believed over metadata, which only ever warns; what cannot be told is left for review."""
    sure = F.col("confidence") >= MIN_CONFIDENCE
    facts = samples.groupBy("book").agg(
        F.sum("chars").alias("coverage"),
        F.array_sort(F.collect_set(F.when(sure, F.col("language")))).alias("found"),
        F.avg(F.when(sure, F.col("confidence"))).alias("mean"),
        F.array_sort(F.collect_set("language")).alias("seen"),
    )
    rows = books.join(facts, "book", "left")
    coverage = F.coalesce("coverage", F.lit(0))
    meta, asked = language_code(F.col("metadata_language")), F.coalesce("override", F.lit(""))
    code, n, one = language_code(F.col("override")), F.size(F.coalesce("found", F.array().cast("array<string>"))), F.element_at("found", 1)
    supported = lambda c: c.isin(*SUPPORTED)
    reason = F.when(asked != "", F.lit(None)).when(coverage < MIN_TOTAL_CHARS, "too little text").when(n == 0, "no clear passage").when(n > 1, "passages disagree").when(~supported(one), "unsupported language")
    language = F.when(asked != "", code).when((coverage >= MIN_TOTAL_CHARS) & (n == 1), one).otherwise("")
    method = F.when(asked != "", "override").when(reason.isNull(), "content").otherwise("")
    confidence = F.when(asked != "", 1.0).when(reason.isNull(), F.round("mean", 4)).otherwise(0.0)
    warning = (
        F.when((asked != "") & ~supported(code), "override unsupported")
        .when((asked != "") & F.col("seen").isNotNull() & ~F.array_contains("seen", code), "text disagrees with override")
        .when((asked == "") & (coverage < MIN_TOTAL_CHARS) & supported(meta), "metadata claims a language")
        .when((method == "content") & (meta != "") & (meta != one), "metadata disagrees with text")
    )
    return rows.select("book", language.alias("language"), method.alias("method"), confidence.alias("confidence"), coverage.cast("long").alias("coverage_chars"), reason.isNotNull().alias("needs_review"), F.coalesce(reason, F.lit("")).alias("reason"), F.coalesce(warning, F.lit("")).alias("warning"))
