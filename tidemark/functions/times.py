"""Timestamps held as text or numbers."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two text formats of the incremental field.
MICROS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SECONDS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Characters that count as white space around a text value.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Year, month, day and optionally a time after white space or `T`; month, day and time may be unpadded.
DAY_PATTERN = (
    r"^(\d{4})-(1[0-2]|0?[1-9])-(3[01]|[12]\d|[0 ]?[1-9])"
    r"(?:(?:\s+|[Tt])(?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d(?:\.\d{1,6})?)?\z"
)

MAX_SECONDS = 253402300800.0  # 10000-01-01
MIN_SECONDS = -62135596800.0  # 0001-01-01


def parse_ts(text: Column) -> Column:
    """Text with or without fraction digits as a timestamp; anything else is null.

    The point decides which of the two formats can fit, so only that one is tried.
    """
    return F.when(
        text.contains("."), F.try_to_timestamp(text, F.lit(MICROS_FORMAT))
    ).otherwise(F.try_to_timestamp(text, F.lit(SECONDS_FORMAT)))


def source_day(text: Column) -> Column:
    """The ISO day of a text value, or null.

    A text that starts with ten characters of an ISO day gives those ten characters whether the
    rest parses or not, so only other shapes reach the pattern. What does not parse but has
    dashes at places 5 and 8 gives its first ten characters unchecked.
    """
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    cut = F.replace(trimmed.substr(1, 26), F.lit("Z"), F.lit(""))
    year, month, day = (F.regexp_extract(cut, DAY_PATTERN, i) for i in (1, 2, 3))
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.trim(day), 2, "0"))
    parsed = F.when((year != "") & (year != "0000") & iso.try_cast("date").isNotNull(), iso)
    dashed = (
        (F.length(trimmed) >= 10)
        & (trimmed.substr(5, 1) == "-")
        & (trimmed.substr(8, 1) == "-")
    )
    return F.when(trimmed.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), trimmed.substr(1, 10)).otherwise(
        F.coalesce(parsed, F.when(dashed, trimmed.substr(1, 10)))
    )


def source_day_of_number(number: Column) -> Column:
    """The UTC day of epoch seconds, or of milliseconds above 1e12; out of range is null."""
    value = number.cast("double")
    seconds = F.when(value > 1e12, value / 1000.0).otherwise(value)
    in_range = ~F.isnan(value) & (seconds >= MIN_SECONDS) & (seconds < MAX_SECONDS)
    seconds = F.when(in_range, seconds)
    whole = F.floor(seconds)
    rounded_up = (F.bround((seconds - whole) * 1e6) >= 1e6).cast("long")
    days = F.floor((whole + rounded_up) / F.lit(86400))
    return F.date_from_unix_date(days.cast("int")).cast("string")


def source_day_of_variant(value: Column) -> Column:
    """`source_day` of a schemaless value: numbers and booleans as numbers, the rest as text."""
    kind = F.schema_of_variant(value)
    return F.when(
        kind == "BOOLEAN",
        source_day_of_number(F.try_variant_get(value, "$", "boolean").cast("double")),
    ).when(
        kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
        source_day_of_number(F.try_variant_get(value, "$", "double")),
    ).otherwise(source_day(F.try_variant_get(value, "$", "string")))


def field_with_fallback(columns: Column, name: str) -> Column:
    """Field `name` of a VARIANT object, else its lower-case spelling.

    A field that is present but null is a VARIANT null, not an SQL null, so it is not replaced.
    """
    return F.coalesce(
        F.variant_get(columns, f"$.{name}", "variant"),
        F.variant_get(columns, f"$.{name.lower()}", "variant"),
    )


def day_start_ms(as_of: datetime, zone: str = "UTC") -> int:
    """Epoch milliseconds of the start of the day of `as_of` in `zone`."""
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    start = as_of.astimezone(ZoneInfo(zone)).replace(hour=0, minute=0, second=0, microsecond=0)
    return int(start.timestamp() * 1000)
