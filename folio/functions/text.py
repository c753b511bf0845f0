r"""Text expressions: Column in, Column out, all inside whole-stage code generation.

Patterns carry (?U) where `\w` and `\s` must see letters beyond ASCII. SURVEY rows TX-01 to TX-14, DC-01, DC-03,
DC-05, DC-07.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SOFT_HYPHEN, BOM = "­", "﻿"

# Letters without a decomposed form and their transliteration.
UNDECOMPOSED = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i"}

# Beginnings of titles that are front or back matter.
FRONT_MATTER = ("spis tre", "table of contents", "contents", "copyright", "colophon", "index", "bibliograf", "przypisy", "footnotes", "acknowledg", "o autorze", "about the author")

# Markers of footnotes in running text.
FOOTNOTE = r"\[\d{1,3}\]|\{\d{1,3}\}|\(\d{1,3}\)(?=\s|$)"

# Letters and signs that belong in Polish or English prose, beyond ASCII.
POLISH_LETTERS = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
LOAN_LETTERS = "áàâäãåéèêëíìîïòôöõøúùûüçñýÿæœßÁÀÂÄÃÅÉÈÊËÍÌÎÏÒÔÖÕØÚÙÛÜÇÑÝÆŒ"
PROSE_SIGNS = "–—…„“”‘’‚«»€£ ­﻿"

# Weights of evidence against a reading.
FOREIGN_WEIGHT, UNEXPECTED_WEIGHT, CONTROL_WEIGHT, REPLACEMENT_WEIGHT = 20.0, 4.0, 50.0, 100.0


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Latin letters with one ASCII letter behind their marks, that letter, and those with several, by decomposition."""
    single, several = {}, {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[char] = plain
        elif plain:
            several[char] = plain
    for char, plain in UNDECOMPOSED.items():
        (single if len(plain) == 1 else several)[char] = plain
    return "".join(single), "".join(single.values()), tuple(several.items())


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    """TX-08."""
    return F.size(words(F.coalesce(c, F.lit("")))).cast("long")


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition with all but ASCII dropped; the longer expansions only where they occur."""
    single, plain, several = _folds()
    rare = "[" + "".join(k for k, _ in several) + "]"
    expanded = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), several, c)
    folded = F.translate(F.when(c.rlike(rare), expanded).otherwise(c), single, plain)
    return F.regexp_replace(folded, r"[^\x00-\x7F]", "")


def slugify(c: Column, default: str = "book") -> Column:
    """TX-01: lower-case ASCII words joined by hyphens, never empty."""
    kept = F.regexp_replace(ascii_fold(c), r"[^\w\s-]", "")
    slug = F.regexp_replace(F.lower(F.regexp_replace(kept, r"^\s+|\s+$", "")), r"[-\s]+", "-")
    return F.when(slug == "", default).otherwise(slug)


def filename_slug(c: Column) -> Column:
    """TX-13: slug of a file name without its extension."""
    name = F.regexp_extract(c, r"([^/]*)$", 1)
    slug = slugify(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))
    bare = F.regexp_replace(slug, r"^[-.]+|[-.]+$", "")
    return F.when(bare == "", "upload").otherwise(bare)


def strip_footnotes(c: Column) -> Column:
    """TX-05."""
    return F.regexp_replace(c, FOOTNOTE, "")


def normalise(c: Column, footnotes: bool = True) -> Column:
    """TX-02: text as a narrator reads it. Line breaks must still be there: words wrapped at a hyphen are joined."""
    c = F.replace(c, F.lit(SOFT_HYPHEN), F.lit(""))
    c = F.regexp_replace(c, r"(?U)(\w)-[ \t]*\r?\n[ \t]*(\w)", "$1$2")
    c = F.regexp_replace(F.regexp_replace(c, "[“-‟]", '"'), "[‘-‛]", "'")
    c = F.regexp_replace(F.replace(c, F.lit("…"), F.lit("...")), "[—–]", " - ")
    return squeeze(strip_footnotes(c) if footnotes else c)


def paragraphs(c: Column, footnotes: bool = True) -> Column:
    """TX-03: normalised blocks between blank lines, of more than one character."""
    blocks = F.transform(F.split(c, r"(?U)\n\s*\n"), lambda x: normalise(x, footnotes))
    return F.filter(blocks, lambda x: F.length(x) > 1)


def is_front_matter(title: Column) -> Column:
    """TX-04."""
    return F.coalesce(title, F.lit("")).rlike("(?iu)^(" + "|".join(FRONT_MATTER) + ")")


def is_safe_name(c: Column) -> Column:
    """TX-06: one to a hundred letters, digits, dots, underscores and hyphens, the first a letter or digit."""
    return F.coalesce(c, F.lit("")).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}\z")


def is_contained(root: Column, path: Column) -> Column:
    """TX-06: whether a path without `..` lies below root."""
    return path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def language_code(c: Column) -> Column:
    """TX-07: `pl-PL` and `en_GB` are `pl` and `en`."""
    return F.lower(F.split(F.translate(strip(F.coalesce(c, F.lit(""))), "_", "-"), "-")[0])


def excerpt(text: Column, start: Column, end: Column, width: int = 90) -> Column:
    """TX-09: about `width` characters around a 0-based half-open span, with an ellipsis where text is left out."""
    room = F.floor(F.greatest(F.lit(width) - (end - start), F.lit(0)) / 2).cast("int")
    left, right = F.greatest(start - room, F.lit(0)), F.least(end + room, F.length(text))
    inner = strip(F.substring(text, left + 1, right - left))
    return F.concat(F.when(left > 0, "…").otherwise(""), inner, F.when(right < F.length(text), "…").otherwise(""))


def comparison_tokens(c: Column) -> Column:
    """TX-10: lower-case words without signs. Letters keep their marks; text is taken to be in normal form already."""
    return words(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "))


def timestamp_label(seconds: Column) -> Column:
    """TX-11: HH:MM:SS.mmm, cut and not rounded."""
    whole = F.floor(seconds)
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, F.floor((seconds - whole) * 1000)))


def duration_label(seconds: Column) -> Column:
    """TX-11: `2h 05m`, `3m 09s` or `7s`."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s % 60)).when(s.isNotNull(), F.format_string("%ds", s))


def _tenths(x: Column) -> Column:
    """10 * x as a whole number, rounded from x's exact value and half to even, as C's `%.1f` does; Java's rounds the
    shortest decimal that reads as x, and half up."""
    ten = 8 * x + 2 * x
    lost = 2 * x - (ten - 8 * x)  # what the sum lost: both terms are exact
    near = F.rint(ten)
    return near + F.when((ten - near == 0.5) & (lost > 0), 1.0).when((ten - near == -0.5) & (lost < 0), -1.0).otherwise(0.0)


def size_label(size: Column) -> Column:
    """TX-11: bytes as B, KB, MB or GB."""
    size = size.cast("double")

    def scaled(k: int, unit: str) -> Column:
        tenths = _tenths(size / 1024**k)
        return F.format_string(f"%.0f.%.0f {unit}", F.rint((tenths - tenths % 10) / 10), tenths % 10)

    label = F.when(size < 1024, F.format_string("%.0f B", F.rint(size))).when(size < 1024**2, scaled(1, "KB")).when(size < 1024**3, scaled(2, "MB"))
    return label.when(size.isNotNull(), scaled(3, "GB"))


def metadata_value(c: Column) -> Column:
    r"""TX-12: `=`, `;`, `#`, `\` and line breaks behind a backslash."""
    lines = F.regexp_replace(c, "\r\n?", "\n")
    return F.regexp_replace(lines, r"([=;#\\\n])", r"\\$1")


def concat_line(path: Column) -> Column:
    """TX-12: a quoted line of a concatenation list."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def parse_bitrate(c: Column, default: int = 64_000) -> Column:
    """TX-14: `64k`, `1.5m` or a number, in bits per second."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    number = F.regexp_replace(text, "[km]$", "").try_cast("double")
    unit = F.when(text.endswith("k"), 1000).when(text.endswith("m"), 1_000_000).otherwise(1)
    return F.coalesce((number * unit).cast("long"), F.lit(default).cast("long"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once however often body uses it: the one element of an array."""
    return F.transform(F.array(value), body)[0]


def _count(c: Column, others: str) -> Column:
    """Characters of c outside runs of others."""
    return F.length(F.regexp_replace(c, f"{others}+", ""))


def text_quality(c: Column) -> Column:
    """DC-03: how plausible a reading is as Polish or English prose; correct prose is near 1."""

    def score(beyond: Column) -> Column:
        controls = _count(beyond, "[^\u0080-\u009f]")
        replaced = _count(beyond, "[^�]")
        foreign = _count(beyond, f"[\u0080-\u009f�{POLISH_LETTERS}{LOAN_LETTERS}{PROSE_SIGNS}]")
        penalty = (CONTROL_WEIGHT * controls + REPLACEMENT_WEIGHT * replaced + FOREIGN_WEIGHT * foreign) / F.length(c)
        plain = _count(c, "[^A-Za-z]")
        found = F.struct((plain + _count(beyond, r"\P{L}")).alias("letters"), (plain + _count(beyond, f"[^{POLISH_LETTERS}]")).alias("expected"), penalty.alias("penalty"))
        good = lambda f: f["expected"] / f["letters"] - UNEXPECTED_WEIGHT * ((f["letters"] - f["expected"]) / f["letters"]) - f["penalty"]
        return let(found, lambda f: F.when(f["letters"] == 0, -f["penalty"]).otherwise(good(f)))

    # what stands beyond ASCII is mostly short, and all but two counts need only that
    return F.when(F.length(c) == 0, 0.0).when(c.isNotNull(), let(F.regexp_replace(c, r"[\x00-\x7f]+", ""), score))


def bom_encoding(raw: Column) -> Column:
    """DC-01: the encoding that a byte-order mark declares, the longest mark first; null without one."""
    starts = lambda mark: F.startswith(raw, F.lit(bytes.fromhex(mark)))
    return F.when(starts("fffe0000") | starts("0000feff"), "utf-32").when(starts("efbbbf"), "utf-8-sig").when(starts("fffe") | starts("feff"), "utf-16")


def encoding_family(c: Column) -> Column:
    """DC-05: utf-8, utf-16 and utf-32 with their variants as one name each."""
    name = F.replace(F.translate(F.lower(c), "_", "-"), F.lit("-sig"), F.lit(""))
    return F.when(name.startswith("utf-32"), "utf-32").when(name.startswith("utf-16"), "utf-16").when(name.startswith("utf-8"), "utf-8").otherwise(name)


def without_bom(c: Column) -> Column:
    """DC-04, the part that needs no table: the mark dropped wherever it stands."""
    return F.replace(c, F.lit(BOM), F.lit(""))


def sha256(raw: Column) -> Column:
    """DC-07."""
    return F.sha2(raw, 256)
