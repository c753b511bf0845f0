"""Numeric judgements on fragments and recordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import comparison_tokens

# Thresholds of the checks.
MAX_WER, MAX_WER_BY_LANGUAGE = 0.15, {"pl": 0.18, "en": 0.12}
AUDIO_CHARS_PER_SECOND, TRUNCATION_RATIO = 14.0, 0.55
MIN_AUDIO_SECONDS, MIN_PEAK = 0.15, 1e-4
TARGET_LUFS, PEAK_CEILING_DBTP, MAX_GAIN_DB, SILENT_LUFS = -20.0, -3.0, 12.0, -70.0
MIN_USABLE_SECONDS, GOOD_SECONDS, SILENT_DBFS, CLIPPING_DBFS, MOSTLY_SILENCE = 20.0, 120.0, -50.0, -0.5, 0.6

#: First of the code points that stand for words, and how many there are (private use area and planes).
_FIRST, _SPAN = 0xE000, 6_400
_WIDE_FIRST, _WIDE_SPAN = 0xF0000, 65_534


def word_edits(reference: Column, heard: Column) -> Column:
    """Edits between two word arrays: each distinct word becomes one private-use character, then characters are compared."""

    def symbols(words: Column, vocabulary: Column) -> Column:
        def symbol(x: Column) -> Column:
            place = F.array_position(vocabulary, x).cast("int")
            code = F.when(place <= _SPAN, place + (_FIRST - 1)).otherwise(place + (_WIDE_FIRST - 1 - _SPAN))
            return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")  # four big-endian bytes of a code point

        return F.array_join(F.transform(words, symbol), "")

    # inside the one element of an array, so that the vocabulary is made once and not for each word
    both = F.array(F.struct(reference.alias("a"), heard.alias("b"), F.array_distinct(F.concat(reference, heard)).alias("v")))
    return F.transform(both, lambda s: F.levenshtein(symbols(s["a"], s["v"]), symbols(s["b"], s["v"])))[0]


def word_error_rate(expected: Column, heard: Column) -> Column:
    """QA-01: edits over reference words, four decimals; an empty reference counts whole or not at all."""
    a, b = comparison_tokens(expected), comparison_tokens(heard)
    rate = F.round(word_edits(a, b) / F.size(a), 4)
    return F.when(F.size(a) > 0, rate).when(F.size(b) == 0, 0.0).otherwise(1.0)


def wer_threshold(language: Column, override: float = 0.0) -> Column:
    """QA-02: by language, unless one value is given for all."""
    if override:
        return F.lit(override)
    by = F.create_map(*(F.lit(x) for kv in MAX_WER_BY_LANGUAGE.items() for x in kv))
    return F.coalesce(by[language], F.lit(MAX_WER))


def qa_is_stale(checked: Column, rendered: Column) -> Column:
    """QA-03: whether a report describes other fragments than those rendered now."""
    return (F.coalesce(checked, F.lit("")) != "") & ~checked.eqNullSafe(rendered)


def coverage_word(available: Column, full: Column) -> Column:
    """QA-03."""
    return F.when(available.isNull(), "").when(~(available > 0), "unknown").when(full, "full").otherwise("sampled")


def looks_truncated(chars: Column, seconds: Column) -> Column:
    """QA-04: audio far shorter than its text."""
    return (chars > 0) & (seconds > 0) & (seconds < chars / AUDIO_CHARS_PER_SECOND * TRUNCATION_RATIO)


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))).cast("double"), F.lit(0.0))


def duration(samples: Column, rate: int) -> Column:
    return F.size(samples) / F.lit(rate)


def is_silent(samples: Column, rate: int) -> Column:
    """QA-05: too short or too quiet to be speech."""
    return (duration(samples, rate) < MIN_AUDIO_SECONDS) | (peak(samples) < MIN_PEAK)


def gain_for(lufs: Column, dbtp: Column, target: float = TARGET_LUFS, ceiling: float = PEAK_CEILING_DBTP, most: float = MAX_GAIN_DB) -> Column:
    """QA-06: decibels to the target, never past the peak ceiling; null where there is no speech to measure."""
    wanted = F.lit(target) - lufs
    allowed = F.when(wanted > 0, F.least(wanted, F.lit(ceiling) - dbtp)).otherwise(wanted)
    return F.when(lufs > SILENT_LUFS, F.bround(F.greatest(F.lit(-most), F.least(F.lit(most), allowed)), 1))


def apply_gain(samples: Column, gain_db: Column) -> Column:
    """QA-07: struct<samples, clipped>: scaled to the gain and held within full scale."""
    factor = F.pow(F.lit(10.0), gain_db / 20)
    scaled = F.transform(samples, lambda x: x * factor)
    over = F.size(F.filter(scaled, lambda x: F.abs(x) > 1))
    held = F.transform(scaled, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    none = F.abs(gain_db) < 0.05
    return F.struct(F.when(none, F.transform(samples, lambda x: x.cast("double"))).otherwise(held).alias("samples"), F.when(none, 0).otherwise(over).alias("clipped"))


def recording_findings(seconds: Column, peak_dbfs: Column, silence: Column, channels: Column) -> Column:
    """QA-08: names of what is wrong or worth knowing about a recording."""
    found = F.array(
        F.when(seconds < MIN_USABLE_SECONDS, "too short").when(seconds < GOOD_SECONDS, "short"),
        F.when(peak_dbfs.isNull(), "no level").when(peak_dbfs <= SILENT_DBFS, "silent").when(peak_dbfs >= CLIPPING_DBFS, "clipped"),
        F.when(silence >= MOSTLY_SILENCE, "mostly silence"),
        F.when(channels > 1, "several channels"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def failure_kind(kind: Column, message: Column) -> Column:
    """QA-09: whether a failure is the voice's, the model's or this fragment's alone."""
    text = F.lower(F.concat_ws(": ", kind, message))
    # Words of messages that tell the kinds apart.
    return F.when((kind == "FileNotFoundError") | text.rlike("voice profile|latent"), "voice").when(text.rlike("checkpoint|cuda|out of memory|load_model|no such file or directory"), "model").otherwise("fragment")
