"""CASE rules: statuses, flags, volume tiers, orders of tiers, failure classes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags of the daily inspection.
DUPLICATE_FLAG = "!DUP_KEYS"
CATCH_UP_FLAG = "~re-upsert/catch-up"
MISSING_DAY = "<missing>"

# What the message of an absent table contains, and the classes of report rows.
ABSENT_MARKS = ("not found", "404")
ERROR_ROW, WARNING_ROW, CATCH_UP_ROW = "err", "warn", "catchup"

# Codes in the messages of failures, by class.
MISSING_OBJECT_CODES = ("42P01", "TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND")
UNRESOLVED_COLUMN_CODES = ("42703", "UNRESOLVED_COLUMN")

# Lower bounds of tiers 2 to 5 in rows; the bounds are half open.
TIER_BOUNDS = (1_000_000, 10_000_000, 100_000_000, 1_000_000_000)

# Tier orders of the report, of the load and of the split.
REPORT_ORDER = ("1", "2", "?", "3", "4", "5")
LOAD_ORDER = ("1", "?", "2", "3", "4", "5")
SPLIT_ORDER = ("5", "4", "3", "2", "1", "?")


def _any_of(text: Column, marks: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(m) for m in marks])


def reconcile_status(ingested: Column, expected: Column) -> Column:
    """Equality is tested first, so an empty table that should be empty is OK."""
    return (
        F.when(ingested == expected, "OK")
        .when(ingested == 0, "EMPTY")
        .when(ingested < expected, "MISSING")
        .otherwise("EXTRA")
    )


def ingest_flag(rows: Column, unique_keys: Column, today: Column, before: Column) -> Column:
    return (
        F.when(rows != unique_keys, DUPLICATE_FLAG)
        .when((rows > 0) & (before > today), CATCH_UP_FLAG)
        .otherwise("")
    )


def table_status(present: Column, message: Column) -> Column:
    """OK, MISSING or ERROR from the presence of a table and the message of a failed read."""
    return (
        F.when(_any_of(F.lower(message), ABSENT_MARKS), "MISSING")
        .when(message.isNotNull(), "ERROR")
        .when(present, "OK")
        .otherwise("MISSING")
    )


def report_row_class(status: Column, flag: Column) -> Column:
    return (
        F.when(status != "OK", ERROR_ROW)
        .when(flag == DUPLICATE_FLAG, WARNING_ROW)
        .when(flag == CATCH_UP_FLAG, CATCH_UP_ROW)
        .otherwise("")
    )


def tier_of_volume(rows: Column, bounds: Sequence[int] = TIER_BOUNDS) -> Column:
    """Tier 1 to 5 by row count, `?` when the table was not counted."""
    tier = F.when(rows.isNull(), "?")
    for number, bound in enumerate(bounds, start=1):
        tier = tier.when(rows < bound, str(number))
    return tier.otherwise(str(len(bounds) + 1))


def tier_rank(tier: Column, order: Sequence[str] = REPORT_ORDER) -> Column:
    """Place of a tier in `order`; tiers outside it come last."""
    rank = F.when(tier == order[0], 0)
    for place, name in enumerate(order[1:], start=1):
        rank = rank.when(tier == name, place)
    return rank.otherwise(len(order))


def error_class(message: Column) -> Column:
    """Absent object, unresolved column or other, from codes in the message."""
    return (
        F.when(_any_of(message, MISSING_OBJECT_CODES), "missing_object")
        .when(_any_of(message, UNRESOLVED_COLUMN_CODES), "unresolved_column")
        .otherwise("other")
    )


def first_line(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)
