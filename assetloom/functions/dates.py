"""Dates kept as naive ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_NAIVE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?$"


def instant(as_of: str) -> Column:
    return F.lit(as_of.replace("T", " ")).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """ISO text of a timestamp; the fraction is written only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def parse_naive(text: Column) -> Column:
    """Naive ISO text to ``timestamp_ntz``; other text (offsets too) gives NULL."""
    padded = F.when(F.length(text) == 13, F.concat(text, F.lit(":00"))).otherwise(text)
    return F.when(text.rlike(ISO_NAIVE), padded.try_cast("timestamp_ntz"))


def parse_any(text: Column) -> Column:
    """Naive or offset-carrying ISO text on one UTC time line, for ordering."""
    naive = F.regexp_replace(text, r"(Z|[+-]\d{2}(:?\d{2})?)$", "")
    offset = F.regexp_extract(text, r"[T ][\d:.]+([+-]\d{2}):?(\d{2})?$", 1)
    hours = F.coalesce(F.when(offset != "", offset.try_cast("int")), F.lit(0))
    base = parse_naive(F.when(text.rlike(r"[T ]\d{2}"), naive).otherwise(text))
    return base - F.make_dt_interval(F.lit(0), hours)


def days_since(text: Column, as_of: str) -> Column:
    """Whole days from a stored date to ``as_of``; unreadable or future dates give 0."""
    days = F.extract(F.lit("DAY"), instant(as_of) - parse_naive(text))
    return F.greatest(F.lit(0), F.coalesce(days, F.lit(0))).cast("int")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def utc_instant(naive: Column) -> Column:
    """The instant a naive UTC time names, whatever the session's time zone."""
    span = naive - _epoch()
    days, hours, minutes, seconds = (F.extract(F.lit(f), span) for f in ("DAY", "HOUR", "MINUTE", "SECOND"))
    whole = ((days.cast("bigint") * 24 + hours) * 60 + minutes) * 60_000_000
    return F.timestamp_micros(whole + (seconds * 1_000_000).cast("bigint"))


def utc_naive(instant_: Column) -> Column:
    """The naive UTC time of an instant."""
    seconds = (F.unix_micros(instant_) / 1_000_000).cast("decimal(18,6)")
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
