"""Posted dates of the feeds, each brought to a timestamp; null when undatable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.text import strip

# Date, then optionally one separator character and a time with optional fraction and offset.
_ISO = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)

# Year and week, then optionally the day of the week; the rest is as in other ISO text.
_WEEK = r"^(\d{4})(-?)W(\d{2})(?:\2(\d))?(?![\d-])"

# Day of the week, day, month, year, time, offset.
_MAIL = (
    r"^(?:[A-Za-z]+\.?,?\s*)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*\.?,?[\s-]+(\d{4}|\d{2})"
    r",?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4})?$"
)

# Zone names that mail dates may carry instead of an offset.
MAIL_ZONES = {
    "GMT|UTC|UT|Z": "+0000",
    "EDT": "-0400",
    "EST|CDT": "-0500",
    "CST|MDT": "-0600",
    "MST|PDT": "-0700",
    "PST": "-0800",
}


# Seconds of the years 1 to 9999, beyond which there is no date.
_FIRST_SECOND, _LAST_SECOND = -62_135_596_800, 253_402_300_799

_NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"


def from_epoch_seconds(c: Column) -> Column:
    """Seconds since 1970, as a number or as its text, fractions included; null when out of range."""
    seconds = c.try_cast("decimal(30,6)")
    return F.when(seconds.between(_FIRST_SECOND, _LAST_SECOND), F.timestamp_seconds(seconds))


def from_number_or_iso(c: Column) -> Column:
    """A date whose shape decides how it is read: digits are epoch seconds, the rest ISO text."""
    return F.when(c.rlike(_NUMBER), from_epoch_seconds(c)).otherwise(from_iso_text(c))


def stated(c: Column) -> Column:
    """The text of a date that is given; blank and zero count as not given.

    A number with a fraction comes out of JSON in powers of ten and is written out again."""
    plain = F.regexp_replace(c.try_cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    c = F.when(c.rlike(r"^[+-]?\d+(\.\d+)?[eE]"), F.coalesce(plain, c)).otherwise(c)
    return F.when((c != "") & F.coalesce(c.try_cast("double") != 0, F.lit(True)), c)


def _calendar_text(c: Column) -> Column:
    """ISO text with a week date ('2026-W31-4') as text with the day's calendar date.

    Week 1 has January 4 and starts on a Monday, and a week without a day is its Monday. Null for a
    week or a day that the year does not have; other text stays."""
    part = [F.regexp_extract(c, _WEEK, k) for k in (1, 3, 4)]
    year, week, day = (F.when(p == "", F.lit(1)).otherwise(p.try_cast("int")) for p in part)
    fourth = F.when(year >= 1, F.make_date(year, F.lit(1), F.lit(4)))
    monday = F.date_add(fourth, (week - 1) * 7 - F.weekday(fourth))
    given = week.between(1, 53) & day.between(1, 7) & (F.weekofyear(monday) == week)
    date = F.when(given, F.date_format(F.date_add(monday, day - 1), "yyyy-MM-dd"))
    return F.when(c.rlike(_WEEK), F.concat(date, F.regexp_replace(c, _WEEK, ""))).otherwise(c)


def from_iso_text(c: Column) -> Column:
    """ISO text to timestamp; text without an offset is UTC whatever the session zone is.

    The pattern is checked first because a cast also takes shapes that are not ISO
    ('2026', a zone name after the time). Absent parts come out blank and are filled in.
    """
    c = _calendar_text(c)
    text = F.regexp_replace(c, _ISO, "$1-$3-$4T$5:$6:$7.$8Z$9")
    for blank, filled in (("T:", "T00:"), ("::", ":00:"), (":.", ":00."), (".Z", ".0Z")):
        text = F.replace(text, F.lit(blank), F.lit(filled))
    text = F.regexp_replace(text, r"Z(.+)$", "$1")
    return F.when(c.rlike(_ISO), text.try_cast("timestamp"))


def from_mail_text(c: Column) -> Column:
    """RSS date ('Thu, 30 Jul 2026 15:23:41 +0000') to timestamp.

    Comments in parentheses go, month names may be written out, a missing zone is UTC, and of years of two digits
    those from 69 on are in the last century."""
    text = strip(F.regexp_replace(c, r"\([^()]*\)", " "))
    for names, offset in MAIL_ZONES.items():
        text = F.regexp_replace(text, rf"(?i)\s*\b(?:{names})$", f" {offset}")
    part = [F.regexp_extract(text, _MAIL, k) for k in range(1, 8)]
    day, month, year, hour, minute, second, zone = part
    century = F.when(year < "69", "20").otherwise("19")
    year = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
    given = lambda value, absent: F.when(value != "", value).otherwise(absent)
    clock = F.concat_ws(":", F.lpad(hour, 2, "0"), minute, given(second, "00"))
    whole = F.concat_ws(" ", day, F.initcap(month), year, clock, given(zone, "+0000"))
    return F.when(text.rlike(_MAIL), F.try_to_timestamp(whole, F.lit("d MMM yyyy HH:mm:ss Z")))


def within_window(posted_at: Column, since: Column | None) -> Column:
    """Keep a row unless it is known to be older than ``since``."""
    if since is None:
        return F.lit(True)
    return since.isNull() | posted_at.isNull() | (posted_at >= since)
