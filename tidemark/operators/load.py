"""One load of one query, and runs over many queries with a ledger."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.classify import error_class, first_line
from tidemark.functions.times import parse_ts
from tidemark.operators.extract import INCREMENTAL_FIELD, INITIAL_START, keyed_incremental
from tidemark.operators.sink import ABSENT, COLUMNS, LOAD, read_load, schemaless, write_load
from tidemark.operators.state import last_mark, mark_value, write_mark
from tidemark.session import in_parallel

# Folder beside the loads: keys of rows whose field is no timestamp.
NOTED = "_malformed"
LEDGER = "query string, status string, rows long, seconds double, message string"


def run_load(
    spark: SparkSession,
    source: DataFrame,
    query: str,
    sink: str,
    state: str,
    load_id: int,
    initial_start: str = INITIAL_START,
    field: str = INCREMENTAL_FIELD,
    updated_ms: int | None = None,
    rows_per_file: int | None = None,
    day_column: str | None = None,
    as_variant: bool = False,
    new_rows_only: bool = False,
) -> int:
    """Read from the mark on, key, store, then move the mark. Returns the rows stored.

    `new_rows_only` says that `source` holds rows of no other load, as a batch of new files does.
    Then all from the initial start on are stored, wherever the mark stands.

    Sink first, mark second: a failure between the two repeats the load, which replaces its own
    rows. Count and mark are read back from what was stored, so the source is read and keyed
    once, and a retried task cannot count twice. A delta is a thin slice of every source
    partition; it is rebalanced so that each load adds few files. The catch-up is not, it would
    shuffle the whole source. `as_variant` stores the columns as one VARIANT.

    Text that is no timestamp passes the filter at every load, as it is never below the mark. The
    keys of such rows are noted beside the table, and rows noted by an earlier load are left out.
    """
    last = last_mark(spark, state, query, before_load=load_id)
    mark = initial_start if last is None else last["high_water"]
    start = initial_start if new_rows_only else mark
    rows = keyed_incremental(source, start, field, day_column)
    if last is not None:
        rows = rows.hint("rebalance")
        known = None if new_rows_only else _noted(spark, sink, load_id)
        if known is not None:
            seen_before = parse_ts(F.col(field)).isNull() & F.col("_noted").isNotNull()
            joined = rows.join(known, F.col("key") == F.col("_noted"), "left")
            rows = joined.where(~seen_before).drop("_noted")
    value = F.col(field)
    if as_variant:
        rows, value = schemaless(rows), F.try_variant_get(COLUMNS, f"$.{field}", "string")
    write_load(rows, sink, load_id, updated_ms, rows_per_file)
    stored = read_load(spark, sink, load_id, rows.schema)
    odd = parse_ts(value).isNull()
    n, seen, odd_rows = stored.agg(F.count("*"), mark_value(value), F.count_if(odd)).first()
    if odd_rows:
        noted = stored.where(odd).select("key").coalesce(1)
        noted.write.mode("overwrite").parquet(f"{sink}/{NOTED}/{LOAD}={load_id}")
    write_mark(spark, state, query, max(mark, seen or mark), load_id, last)
    return n


def _noted(spark: SparkSession, sink: str, load_id: int) -> DataFrame | None:
    """Keys of rows without a timestamp that earlier loads have stored."""
    try:
        keys = spark.read.schema(f"key string, {LOAD} bigint").parquet(f"{sink}/{NOTED}")
    except AnalysisException as e:
        if e.getCondition() in ABSENT:
            return None
        raise
    return keys.where(F.col(LOAD) < load_id).select(F.col("key").alias("_noted")).distinct()


def run_all(
    spark: SparkSession, loads: Iterable[tuple[str, Callable[[], int]]], parallel: int = 1
) -> DataFrame:
    """Run the loads, started in order, and return the ledger, one row per query.

    A failing query is recorded with its message and the run goes on. `parallel` loads run at a
    time, so that small ones do not leave the cluster idle. The driver holds one row per query.
    """

    def run(item: tuple[str, Callable[[], int]]) -> tuple:
        query, load = item
        started = time.monotonic()
        rows, message = None, None
        try:
            rows = load()
        except Exception as e:  # whatever fails belongs to this query alone
            message = str(e) or type(e).__name__
        status = "failure" if message else "success"
        return query, status, rows, time.monotonic() - started, message

    return spark.createDataFrame(in_parallel(spark, run, loads, parallel), LEDGER).select(
        "query", "status", "rows", "seconds",
        F.when(F.col("message").isNotNull(), error_class(F.col("message"))).alias("error_class"),
        first_line(F.col("message")).alias("message"),
    )


def run_result(ledger: DataFrame) -> DataFrame:
    """One row: queries, rows and the names of failed queries; a run fails if any query failed."""
    failed = F.col("status") == "failure"
    return ledger.agg(
        F.count("*").alias("queries"),
        F.count_if(~failed).alias("succeeded"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.concat_ws(", ", F.array_sort(F.collect_list(F.when(failed, F.col("query"))))).alias("failed"),
    ).withColumn("status", F.when(F.col("failed") == "", "success").otherwise("failure"))
