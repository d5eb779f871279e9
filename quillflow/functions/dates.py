"""Publication dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

_MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?(?![a-z])"
_OFFSET = r"([+\-]\d{2}):?(\d{2})$"
# Day-first, month-first and ISO shapes; every candidate text carries a numeric offset.
_FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm Z",
    "d MMM yy HH:mm:ss Z",
    "d MMM yyyy Z",
    "MMM d yyyy HH:mm:ss Z",
    "MMM d yyyy HH:mm Z",
    "MMM d yyyy h:mm a Z",
    "MMM d yyyy Z",
    "MMM d HH:mm:ss yyyy Z",
)
# Numeric shapes and the ISO form of each: compact dates and times, slashes with the year first, the day first
# where it can be no month, else the month first.
_NUMERIC = (
    (r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(\d{2})(?!\d)", "$1-$2-$3T$4:$5:$6"),
    (r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(?!\d)", "$1-$2-$3T$4:$5"),
    (r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3"),
    (r"^(\d{4})/(\d{2})/(\d{2})(?!\d)", "$1-$2-$3"),
    (r"^(1[3-9]|2\d|3[01])/(\d{2})/(\d{4})(?!\d)", "$3-$2-$1"),
    (r"^(\d{2})/(\d{2})/(\d{4})(?!\d)", "$3-$1-$2"),
)


def parse_published(raw: Column, tz_hint: Column) -> Column:
    """Instant of an RFC-822 or ISO-8601 text.

    A text without an offset is wall-clock time in `tz_hint`, or in UTC when the hint is unknown.
    Texts that are no date give null.
    """
    text = F.trim(raw)
    text = F.regexp_replace(text, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    for shape, iso in _NUMERIC:
        text = F.regexp_replace(text, shape, iso)
    text = F.regexp_replace(text, r"(?i)(?<=[\d\s])(?:GMT|UTC|Z)$", " +0000")
    # Other zone names say nothing reliable, so the hint decides.
    text = F.regexp_replace(text, r"(?<=\d)\s+(?![AP]M$)[A-Z]{2,5}$", "")
    text = F.trim(F.regexp_replace(text, r"[\s,]+", " "))
    zoned = text.rlike(r"\d:\d{2}(?:[:.,\d]*)\s*[+\-]\d{2}:?\d{2}$")
    known = F.concat(F.lit("2000-01-01 00:00:00 "), tz_hint).try_cast("timestamp").isNotNull()
    zone = F.when(known, tz_hint).otherwise(F.lit("UTC"))
    return bind(F.struct(text.alias("text"), zoned.alias("zoned")), lambda d: F.when(
        d["zoned"], _instant(F.regexp_replace(d["text"], r"(?<=\d)\s*" + _OFFSET, " $1$2"))).otherwise(
        F.to_utc_timestamp(_instant(F.concat(d["text"], F.lit(" +0000"))), zone)))


def _instant(text: Column) -> Column:
    """Instant of a date text that ends in a numeric offset."""
    return bind(text, lambda t: F.when(t.rlike(r"^\d{4}-"), F.try_to_timestamp(_iso(t))).otherwise(
        bind(_named(t), lambda n: F.coalesce(*[F.try_to_timestamp(n, F.lit(f)) for f in _FORMATS]))))


def _iso(text: Column) -> Column:
    tight = F.regexp_replace(text, r" ?" + _OFFSET, "$1:$2")
    dated = F.regexp_replace(tight, r"^(\d{4}-\d{2}-\d{2})([+\-]\d{2}:\d{2})$", "$1 00:00:00$2")
    return F.regexp_replace(dated, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})([+\-])", "$1:00$2")


def _named(text: Column) -> Column:
    """Month as a three-letter name, AM and PM in capitals."""
    cased = F.initcap(F.regexp_replace(text, _MONTH, " $1 "))
    return F.replace(F.replace(
        F.trim(F.regexp_replace(cased, r"\s+", " ")), F.lit(" Am "), F.lit(" AM ")), F.lit(" Pm "), F.lit(" PM "))
