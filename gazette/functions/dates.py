"""Dates and times from feeds and mixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

MICROS_PER_DAY = 86_400_000_000

# Zone names that mail dates may carry, with their offsets.
MAIL_ZONES = {
    "UT": "+0000",
    "UTC": "+0000",
    "GMT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}


def mail_date(c: Column | str) -> Column:
    """RFC 822 date such as ``Tue, 04 Aug 2026 10:00:00 GMT``; NULL when it does not parse."""
    text = F.regexp_replace(F.trim(col(c)), r"^[A-Za-z]{3,9},\s*", "")
    name = F.regexp_extract(text, r"\s([A-Z]{1,3})$", 1)
    zones = F.create_map(*[F.lit(v) for pair in MAIL_ZONES.items() for v in pair])
    offset = F.try_element_at(zones, name)
    text = F.when(offset.isNotNull(), F.concat(F.regexp_replace(text, r"[A-Z]{1,3}$", ""), offset)).otherwise(text)
    # Years of two digits: up to 68 of this century, from 69 on of the last.
    short = F.regexp_extract(text, r"^\d{1,2} [A-Za-z]{3} (\d{2}) ", 1)
    century = F.when(short <= "68", F.lit("20")).otherwise(F.lit("19"))
    long = F.concat(F.regexp_extract(text, r"^(\d{1,2} [A-Za-z]{3} )\d{2} ", 1), century, F.regexp_extract(text, r"^\d{1,2} [A-Za-z]{3} (\d{2} .*)$", 1))
    text = F.when(short != "", long).otherwise(text)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss")),
    )


def iso_timestamp(c: Column | str) -> Column:
    """ISO 8601 text; a value without a zone is read as UTC (the session zone)."""
    c = F.trim(col(c))
    return F.when(c.rlike(r"^\d{4}-\d{2}"), c.try_cast("timestamp"))


def feed_timestamp(*columns: Column | str) -> Column:
    """First of the given text columns that holds an ISO or a mail date."""
    tries = []
    for c in columns:
        tries += [iso_timestamp(c), mail_date(c)]
    return F.coalesce(*tries)


def coerce_date(c: Column | str) -> Column:
    """Date of an ISO text, else of its first ten characters, else NULL."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(
        iso_timestamp(text).cast("date"),
        F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"),
    )


def age_in_days(as_of: Column, event_at: Column | str) -> Column:
    """Days between two times as a double, never negative."""
    micros = F.unix_micros(as_of) - F.unix_micros(col(event_at))
    return F.greatest(F.lit(0.0), micros.cast("double") / F.lit(float(MICROS_PER_DAY)))
