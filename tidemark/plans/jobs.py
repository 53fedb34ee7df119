"""The catalogue of sources as loads: the live extract, the previous one, and their split."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.extract import INITIAL_START, windowed_extract
from tidemark.operators.history import (
    append_history,
    day_over_day_delta,
    history_entry,
    history_previous,
    parse_history,
    read_history,
)
from tidemark.operators.inspect import inspect_tables, per_table
from tidemark.operators.load import run_all, run_load
from tidemark.operators.reconcile import reconcile_counts, union_counts
from tidemark.operators.stats import summary_by_domain
from tidemark.plans.load_plan import balanced_split, split_order
from tidemark.sources.catalogue import Source, split_place

Reader = Callable[[Source], DataFrame]


def load_sources(
    spark: SparkSession,
    sources: Iterable[Source],
    read: Reader,
    sink_root: str,
    state: str,
    load_id: int,
    initial_start: str = INITIAL_START,
    updated_ms: int | None = None,
    parallel: int = 1,
    **options,
) -> DataFrame:
    """One incremental load of every source, started in the given order; returns the ledger.

    `read` opens a source, for instance `lambda s: spark.table(f"hub.v_{s.view.lower()}")`;
    `options` are further arguments of `run_load`.
    """

    def job(s: Source):
        def go() -> int:
            return run_load(
                spark, read(s), s.query_name, f"{sink_root}/{s.domain}/{s.view}", state, load_id,
                initial_start, updated_ms=updated_ms, **options,
            )
        return s.query_name, go

    return run_all(spark, [job(s) for s in sources], parallel)


def previous_extract(
    source: Source, df: DataFrame, as_of: datetime, sample: int | None = None
) -> DataFrame:
    """The extract of the previous generation: business key and load by tier, of all rows.

    `sample` cuts it to a few rows, for trials of sources that were run so (`source.sampled`).
    """
    return windowed_extract(df, source.key_columns, f"{source.view}_PK", source.load, as_of, sample)


def daily_inspection(
    spark: SparkSession,
    catalog: DataFrame,
    tables: Mapping[str, str],
    since_ms: int,
    today: str,
    history_path: str,
    seq: int,
    generated_at: str,
    tiered_domains: Sequence[str],
    labels: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Inspect the stored tables, compare with the last run of another day, and record the run.

    Returns the statistics per table and the change per domain. `tables` maps a table to its
    folder, `history_path` holds the runs so far, if any. The run is recorded last.
    """
    found = inspect_tables(spark, catalog, tables, since_ms, today)
    by_domain = summary_by_domain(found)
    try:
        previous = history_previous(read_history(spark, history_path), today)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        previous = history_previous(parse_history(spark.createDataFrame([], "line string")), today)
    change = day_over_day_delta(by_domain, previous)
    change = spark.createDataFrame(change.collect(), change.schema)  # one row per domain
    append_history(history_entry(found, tiered_domains, seq, today, generated_at, labels), history_path)
    return found, change


def reconcile_sources(
    spark: SparkSession, expected: DataFrame, tables: Mapping[str, str], parallel: int = 8
) -> DataFrame:
    """Recorded counts (`table`, `expected_rows`) against the keys of the stored tables.

    A table that cannot be read counts as empty, with the message of its failure.
    """

    def summarize(rows: DataFrame, _: DataFrame, failures: DataFrame) -> DataFrame:
        report = reconcile_counts(union_counts(expected, rows))
        failed = failures.select(F.col("table").alias("key"), "message")
        return report.join(failed, "key", "left")

    return per_table(spark, tables, summarize, parallel=parallel)


def plan_rows(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Sources as input of the load plan, one row each."""
    return spark.createDataFrame(
        [(s.view, s.tier, s.rows, split_place(s)) for s in sources],
        "name string, tier string, n bigint, place int",
    )


def extractor_queues(
    spark: SparkSession, sources: list[Source], extractors: int
) -> dict[int, list[Source]]:
    """The sources of every extractor in load order, from the balanced split of their volumes."""
    assigned = balanced_split(plan_rows(spark, sources), extractors)
    queue = split_order(assigned).orderBy("worker", "queue_place").select("worker", "name").collect()
    by_view = {s.view: s for s in sources}
    return {w: [by_view[r["name"]] for r in queue if r["worker"] == w] for w in range(1, extractors + 1)}
