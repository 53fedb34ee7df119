"""Source scans and the filters of an incremental, windowed, full or sample extract."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import business_key, single_column_key, with_key
from tidemark.functions.times import parse_ts
from tidemark.operators.sink import unordered

# The incremental field, the first start and the sample size.
INCREMENTAL_FIELD = "DATETIMESTAMP"
INITIAL_START = "2026-08-01 00:00:00"
SAMPLE_ROWS = 10


def scan_view(spark: SparkSession, name: str) -> DataFrame:
    """All columns of a table or view; the name is quoted where it holds odd characters."""
    return spark.table(name)


def scan_path(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a parquet file or folder."""
    return spark.read.parquet(path)


def incremental_filter(
    df: DataFrame, start: str, field: str = INCREMENTAL_FIELD, day_column: str | None = None
) -> DataFrame:
    """Rows whose text field is at or after `start`, compared as text; nulls drop out.

    The column stays bare, so the comparison reaches the parquet scan. `day_column` names a
    partition column holding the first ten characters of the field: comparing it with the
    first ten of `start` is implied by the text order and prunes partitions.
    """
    kept = df.where(F.col(field) >= F.lit(start))
    return kept if day_column is None else kept.where(F.col(day_column) >= F.lit(start[:10]))


def window_start(as_of: datetime, years: int = 1) -> datetime:
    """The same day `years` earlier; 29 February becomes 28 February."""
    try:
        return as_of.replace(year=as_of.year - years)
    except ValueError:
        return as_of.replace(year=as_of.year - years, day=28)


def window_by_timestamp(
    df: DataFrame, as_of: datetime, field: str = INCREMENTAL_FIELD, years: int = 1
) -> DataFrame:
    """Rows whose field parses to an instant in the last `years`; unparseable text drops out.

    A parsed value cannot be pushed down. Both accepted formats are zero padded, so a text below
    the window start (cut to seconds) cannot parse into the window, unless its year is signed;
    that bound on the bare column does reach the scan.
    """
    start = window_start(as_of, years)
    bound = start.strftime("%Y-%m-%d %H:%M:%S")
    column = F.col(field)
    reachable = (column >= F.lit(bound)) | column.startswith("+")
    instant = F.to_timestamp(F.lit(start.strftime("%Y-%m-%d %H:%M:%S.%f")))
    return df.where(reachable).where(parse_ts(column) >= instant)


def window_by_text(
    df: DataFrame, as_of: datetime, field: str = INCREMENTAL_FIELD, years: int = 1
) -> DataFrame:
    """Rows whose text field is at or after the window start printed to seconds."""
    return df.where(F.col(field) >= F.lit(window_start(as_of, years).strftime("%Y-%m-%d %H:%M:%S")))


def full_load(df: DataFrame) -> DataFrame:
    return df


def smoke_sample(df: DataFrame, order_by: Sequence[str] = (), rows: int = SAMPLE_ROWS) -> DataFrame:
    """A few rows; arbitrary ones unless an order is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def order_incremental(df: DataFrame, field: str = INCREMENTAL_FIELD, *ties: str) -> DataFrame:
    """Total order by the incremental field. A range shuffle: use it to read in order, not to load.

    Equal values are ordered by `ties`, else by a hash of the row, so that a value shared by many
    rows can be split over tasks.
    """
    if not ties:
        ties = (F.xxhash64(*[df[f"`{f.name}`"] for f in df.schema.fields if not unordered(f.dataType)]),)
    return df.orderBy(F.col(field).asc(), *ties)


def key_of(columns: Sequence[str]) -> Column:
    return single_column_key(columns[0]) if len(columns) == 1 else business_key(*columns)


def keyed_incremental(
    df: DataFrame, start: str, field: str = INCREMENTAL_FIELD, day_column: str | None = None
) -> DataFrame:
    """The live extract: rows at or after the mark, keyed by their whole content.

    `day_column` belongs to the layout of the files, not to the row: it prunes and is left out,
    so that rows keep their keys when a source is laid out anew.
    """
    rows = incremental_filter(df, start, field, day_column)
    return with_key(rows if day_column is None else rows.drop(day_column))


def windowed_extract(
    df: DataFrame,
    key_columns: Sequence[str],
    key_name: str,
    load: str,
    as_of: datetime,
    sample: int | None = None,
) -> DataFrame:
    """The previous-generation extract: a business key over a full, text-window or
    timestamp-window load (`load` = full, text, timestamp), optionally cut to a sample."""
    if load == "text":
        df = window_by_text(df, as_of)
    elif load == "timestamp":
        df = window_by_timestamp(df, as_of)
    elif load != "full":
        raise ValueError(f"unknown load {load!r}")
    keyed = with_key(df, key_of(key_columns), key_name)
    return keyed if sample is None else smoke_sample(keyed, rows=sample)
