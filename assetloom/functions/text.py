"""Column expressions for cleaning and rendering text. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges removed as emoji.
EMOJI_RANGES = [
    (0x1F300, 0x1F9FF),
    (0x1F1E0, 0x1F1FF),
    (0x2600, 0x26FF),
    (0x2700, 0x27BF),
    (0x2300, 0x23FF),
]
EMOJI_PATTERN = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]+"
# The outer range lets the matcher dismiss common characters in one comparison.
_FAST_EMOJI = f"[\\x{{{min(EMOJI_RANGES)[0]:X}}}-\\x{{{max(EMOJI_RANGES)[1]:X}}}&&{EMOJI_PATTERN[:-1]}]+"
WIDE_SPACE = chr(0x3000)
# White space removed at either end of a text.
STRIP_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP_CHARS))


def _beyond_ascii(text: Column, change) -> Column:
    """``change(text)``, skipped for pure ASCII text, where it would do nothing."""
    return F.when(F.octet_length(text) > F.length(text), change(text)).otherwise(text)


def _narrow_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(WIDE_SPACE), F.lit(" "))


def _without_emoji(text: Column) -> Column:
    return F.regexp_replace(text, _FAST_EMOJI, "")


def clean_text(text: Column) -> Column:
    """Plain spaces, no emoji, single spaces and underscores, stripped; NULL gives ''."""
    plain = _beyond_ascii(F.coalesce(text, F.lit("")), lambda t: _without_emoji(_narrow_spaces(t)))
    return strip(F.regexp_replace(plain, r"([ _])\1+", "$1"))


def clean_code(code: Column) -> Column:
    """Emoji removed and wide spaces narrowed; layout untouched."""
    return _beyond_ascii(F.coalesce(code, F.lit("")), lambda t: _narrow_spaces(_without_emoji(t)))


def clean_tags(tags: Column) -> Column:
    cleaned = F.transform(F.coalesce(tags, F.array().cast("array<string>")), clean_text)
    return F.filter(cleaned, lambda tag: tag != "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def list_literal(items: Column) -> Column:
    """Render an array the way a Python list of plain strings prints."""
    escaped = F.transform(items, lambda s: F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")))
    body = F.array_join(escaped, "', '")
    return F.when(F.size(items) > 0, F.concat(F.lit("['"), body, F.lit("']"))).otherwise(F.lit("[]"))


def line_count(code: Column) -> Column:
    code = F.coalesce(code, F.lit(""))
    return F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1
