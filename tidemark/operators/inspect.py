"""Daily inspection and counts of stored tables, from their folders."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import (
    field_with_fallback,
    source_day,
    source_day_of_number,
    source_day_of_variant,
)
from tidemark.operators.extract import INCREMENTAL_FIELD
from tidemark.operators.sink import COLUMNS, LOAD, UPDATED, last_per_key, read_loads
from tidemark.operators.stats import table_stats
from tidemark.session import in_parallel

ROWS = "table string, key string, last_updated_time bigint, source_day string"


def _source_day(loads: DataFrame, field: str) -> Column:
    """The source day of a typed column, of columns kept as one VARIANT, or null without the field.

    The field as it is spelled comes first, then its lower-case spelling, row by row. Loads that
    spell it differently are one column already, unless the session tells the spellings apart.
    """
    types = {f.name: f.dataType for f in loads.schema.fields}
    days = None
    for name in dict.fromkeys((field.lower(), field)):
        if name in types:
            numeric = isinstance(types[name], (T.NumericType, T.BooleanType))
            day = source_day_of_number(F.col(name)) if numeric else source_day(F.col(name).cast("string"))
            days = day if days is None else F.when(F.col(name).isNotNull(), day).otherwise(days)
    if days is not None:
        return days
    if isinstance(types.get(COLUMNS), T.VariantType):
        return source_day_of_variant(field_with_fallback(F.col(COLUMNS), field))
    return F.lit(None).cast("string")


def _first_line(e: Exception) -> str:
    return str(e).split("\n", 1)[0] or type(e).__name__


def _open_tables(
    spark: SparkSession, tables: Mapping[str, str], since_ms: int | None, field: str, parallel: int
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Rows per table, and messages of the tables that cannot be opened; absent ones are in neither."""

    def open_table(item: tuple[str, str]) -> tuple[str, DataFrame | None, str | None]:
        table, path = item
        try:
            loads = read_loads(spark, path)
            if loads is None:
                return table, None, None
            day = _source_day(loads, field)
            kept = loads.where(F.col("key").isNotNull())
            if since_ms is not None:
                kept = kept.where(F.col(UPDATED) >= since_ms)
            tagged = kept.select(F.lit(table).alias("table"), "key", UPDATED, day.alias("source_day"), LOAD)
            return table, tagged, None
        except Exception as e:  # a table that cannot be opened is reported, the others go on
            return table, None, _first_line(e)

    opened = in_parallel(spark, open_table, tables.items(), parallel)
    return (
        {table: rows for table, rows, _ in opened if rows is not None},
        {table: message for table, _, message in opened if message is not None},
    )


def _together(
    spark: SparkSession, parts: Mapping[str, DataFrame], failed: Mapping[str, str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    if parts:
        rows = last_per_key(reduce(DataFrame.union, parts.values()), ["table", "key"], [LOAD]).drop(LOAD)
    else:
        rows = spark.createDataFrame([], ROWS)
    one = T.StructType([T.StructField("table", T.StringType())])
    return (
        rows,
        spark.createDataFrame([(t,) for t in parts], one),
        spark.createDataFrame(list(failed.items()), "table string, message string"),
    )


def _unreadable(spark: SparkSession, parts: Mapping[str, DataFrame], parallel: int) -> dict[str, str]:
    """Messages of the tables whose rows cannot be read, each read on its own."""

    def tried(item: tuple[str, DataFrame]) -> tuple[str, str | None]:
        table, rows = item
        try:
            rows.agg(F.count("key"), F.max(UPDATED), F.max("source_day")).collect()
            return table, None
        except Exception as e:
            return table, _first_line(e)

    return {t: m for t, m in in_parallel(spark, tried, parts.items(), parallel) if m is not None}


def stored_rows(
    spark: SparkSession,
    tables: Mapping[str, str],
    since_ms: int | None = None,
    field: str = INCREMENTAL_FIELD,
    parallel: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of many stored tables, the tables that exist, and those that could not be opened.

    All tables become one DataFrame and are collapsed to one row per table and key by one
    shuffle. Later loads carry later times, so the time filter may come before the collapse: a
    key updated since then has its latest row among the rows kept. `parallel` folders are opened
    at a time.
    """
    return _together(spark, *_open_tables(spark, tables, since_ms, field, parallel))


def per_table(
    spark: SparkSession,
    tables: Mapping[str, str],
    summarize: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
    since_ms: int | None = None,
    field: str = INCREMENTAL_FIELD,
    parallel: int = 8,
) -> DataFrame:
    """`summarize` of the `stored_rows` of many tables, whose result has one row per table.

    It runs once over all tables. Should a read fail in it, every table is tried on its own and
    it runs again over the readable ones; the others count as tables that failed.
    """
    parts, failed = _open_tables(spark, tables, since_ms, field, parallel)
    found = summarize(*_together(spark, parts, failed))
    try:
        rows = found.collect()
    except Exception:
        bad = _unreadable(spark, parts, parallel)
        if not bad:
            raise
        parts = {t: rows for t, rows in parts.items() if t not in bad}
        rows = summarize(*_together(spark, parts, failed | bad)).collect()
    return spark.createDataFrame(rows, found.schema)


def inspect_tables(
    spark: SparkSession,
    catalog: DataFrame,
    tables: Mapping[str, str],
    since_ms: int,
    today: str,
    field: str = INCREMENTAL_FIELD,
) -> DataFrame:
    """`table_stats` of stored tables: what was stored since the start of the day."""

    def summarize(rows: DataFrame, present: DataFrame, failures: DataFrame) -> DataFrame:
        return table_stats(catalog, rows, since_ms, today, present, failures)

    return per_table(spark, tables, summarize, since_ms, field)
