"""Daily inspection of keyed tables: per-table statistics and their rollups.

Input `rows` has one line per stored row of every table: `table`, `key`, `last_updated_time`
(epoch ms) and `source_day` (ISO text or null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.classify import (
    CATCH_UP_FLAG,
    DUPLICATE_FLAG,
    MISSING_DAY,
    ingest_flag,
    table_status,
    tier_rank,
)

ENTRY = ("domain", "view", "table", "tier")


def updated_since(rows: DataFrame, since_ms: int) -> DataFrame:
    """Rows stored at or after an instant; the comparison reaches the scan."""
    return rows.where(F.col("last_updated_time") >= F.lit(since_ms))


def rows_updated(fresh: DataFrame, by: str = "table") -> DataFrame:
    return fresh.groupBy(by).agg(F.count("*").alias("rows_today"))


def unique_keys(fresh: DataFrame, by: str = "table") -> DataFrame:
    return fresh.groupBy(by).agg(F.count_distinct("key").alias("unique_keys"))


def day_counts(rows: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Rows per table and source day; everything about days derives from this small result.

    With `since_ms`, rows stored before count for nothing, but their table and day are listed.
    """
    day = F.coalesce("source_day", F.lit(MISSING_DAY)).alias("day")
    n = F.count("*") if since_ms is None else F.count_if(F.col("last_updated_time") >= since_ms)
    return rows.groupBy("table", day).agg(n.alias("n"))


def source_age_split(days: DataFrame, today: str) -> DataFrame:
    """Rows per table by source day: today, missing, and all others, later days included."""
    day = F.col("day")

    def total(condition, name):
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return days.groupBy("table").agg(
        F.sum("n").alias("rows_today"),
        total(day == today, "source_day_today"),
        total((day != today) & (day != MISSING_DAY), "source_day_before"),
        total(day == MISSING_DAY, "source_day_missing"),
    )


def top_source_days(days: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent source days per table with their place; ties go to the earlier text."""
    order = Window.partitionBy("table").orderBy(F.desc("n"), F.asc("day"))
    return days.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def table_stats(
    catalog: DataFrame,
    rows: DataFrame,
    since_ms: int,
    today: str,
    present: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """One row per catalog entry: counts of the day, top source days, status and flag.

    `present` lists the tables that exist (default: those with any row), `failures` the tables
    that could not be read with their messages. Two passes over the rows read disjoint columns:
    keys for the distinct count, source days for all else. With `present`, both read the rows of
    the day alone; without, the pass over the days reads all rows and finds the tables as well.
    All joins are between results of one row per table.
    """
    fresh = updated_since(rows, since_ms)
    days = day_counts(rows, since_ms) if present is None else day_counts(fresh)
    if failures is None:
        failures = rows.sparkSession.createDataFrame([], "table string, message string")

    keys = unique_keys(fresh)
    ages = source_age_split(days, today)
    if present is None:
        found = catalog.join(ages.withColumn("present", F.lit(True)), "table", "left")
    else:
        found = catalog.join(present.withColumn("present", F.lit(True)), "table", "left")
        found = found.join(ages, "table", "left")
    top = top_source_days(days.where("n > 0")).groupBy("table").agg(
        F.array_sort(F.collect_list(F.struct("place", "day", "n"))).alias("top")
    )
    counters = (
        "rows_today", "unique_keys", "source_day_today", "source_day_before", "source_day_missing"
    )
    joined = (
        found.join(failures, "table", "left")
        .join(keys, "table", "left")
        .join(top, "table", "left")
        .withColumn("status", table_status(F.coalesce("present", F.lit(False)), F.col("message")))
    )
    ok = F.col("status") == "OK"
    counted = joined.withColumns(
        {c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)) for c in counters}
    )
    return counted.select(
        *ENTRY,
        *counters,
        F.when(ok, F.transform("top", lambda t: F.struct(t["day"].alias("day"), t["n"].alias("n"))))
        .alias("top_source_days"),
        "status",
        F.when(
            ok,
            ingest_flag(
                F.col("rows_today"), F.col("unique_keys"),
                F.col("source_day_today"), F.col("source_day_before"),
            ),
        ).otherwise("").alias("flag"),
        F.when(~ok, F.col("message")).alias("error"),
    )


def _ok_sum(column: str, name: str):
    return F.sum(F.when(F.col("status") == "OK", F.col(column)).otherwise(0)).alias(name)


_SUMS = (("rows_today", "upd_today"), ("source_day_today", "src_today"), ("source_day_before", "src_old"))


def summary_by_domain(stats: DataFrame) -> DataFrame:
    """Tables by status per domain; rows and flags count for OK tables only."""
    status, flag = F.col("status"), F.col("flag")
    ok = status == "OK"
    return stats.groupBy("domain").agg(
        F.count("*").alias("tables"),
        F.count_if(ok).alias("ok"),
        F.count_if(status == "MISSING").alias("missing"),
        F.count_if(~status.isin("OK", "MISSING")).alias("errors"),
        *[_ok_sum(c, n) for c, n in _SUMS],
        F.count_if(ok & (flag == DUPLICATE_FLAG)).alias("dup_keys"),
        F.count_if(ok & (flag == CATCH_UP_FLAG)).alias("reupsert"),
    )


def summary_by_tier(stats: DataFrame, tiered_domains: Sequence[str]) -> DataFrame:
    """Per tier of the tiered domains: tables of every status, rows of OK tables."""
    return stats.where(F.col("domain").isin(*tiered_domains)).groupBy("tier").agg(
        F.count("*").alias("tables"), *[_ok_sum(c, n) for c, n in _SUMS]
    )


def tier_sort(by_tier: DataFrame) -> DataFrame:
    return by_tier.orderBy(tier_rank(F.col("tier")), "tier")


def run_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("tables"),
        F.coalesce(_ok_sum("rows_today", "s"), F.lit(0)).alias("upd_today"),
        F.count_if(F.col("status") != "OK").alias("errors"),
    )
