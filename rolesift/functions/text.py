"""Text expressions: whitespace, substring tests, the posting key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that Unicode text processing treats as white space. Java's \s and
# trim() know the ASCII ones only.
_SPACE_CODES = (
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
SPACES = "".join(map(chr, _SPACE_CODES))
# The same set inside a pattern; goes with the flag (?U), which makes \s cover Unicode.
SPACE = r"\s\x1c-\x1f"


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def strip_or_blank(c: Column) -> Column:
    return strip(text_or_blank(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_text(c: Column) -> Column:
    """Strip, lower, and turn each run of white space into one space."""
    return F.trim(F.regexp_replace(F.lower(text_or_blank(c)), rf"(?U)[{SPACE}]+", " "))


def posting_hash(company: Column, title: Column, location: Column) -> Column:
    """Stable 64-hex key of a posting."""
    parts = [normalize_text(c) for c in (company, title, location)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def searchable_text(title: Column, location: Column, description: Column) -> Column:
    return F.lower(F.concat_ws("\n", *[text_or_blank(c) for c in (title, location, description)]))


def any_of(conditions: Sequence[Column]) -> Column:
    """OR as a balanced tree, so that long word lists do not nest deeply; no condition is false."""
    if not conditions:
        return F.lit(False)
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return any_of(conditions[:half]) | any_of(conditions[half:])


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """True if any of the words is a substring of an already lowered column."""
    return any_of([lowered.contains(w.lower()) for w in words])


def first_contained(lowered: Column, words: Sequence[str]) -> Column:
    """First word, in list order, that the lowered column contains; null if none."""
    if not words:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(lowered.contains(w.lower()), F.lit(w)) for w in words])


_MARK = "\x01"


def contained_words(lowered: Column, words: Sequence[str]) -> Column:
    """All contained words, in list order, as one marked text; ``how_many`` and ``listed`` read it,
    so that the text itself is searched once.

    Written with concat_ws and substring_index instead of array functions with lambdas, which
    would leave generated code.
    """
    if not words:
        return F.lit("")
    return F.concat_ws(_MARK, *[F.when(lowered.contains(w.lower()), F.lit(w)) for w in words])


def how_many(contained: Column) -> Column:
    marks = F.length(contained) - F.length(F.replace(contained, F.lit(_MARK), F.lit("")))
    return F.when(contained == "", 0).otherwise(marks + 1)


def listed(contained: Column, shown: int) -> Column:
    """The first ``shown`` words joined by comma; blank if none."""
    return F.replace(F.substring_index(contained, _MARK, shown), F.lit(_MARK), F.lit(", "))


def join_parts(sep: str, *parts: Column) -> Column:
    """Join the parts that are not blank."""
    return F.concat_ws(sep, *[blank_to_null(text_or_blank(p)) for p in parts])


def compact_slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
