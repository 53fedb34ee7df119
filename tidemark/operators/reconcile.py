"""Row counts of many tables, and expected against ingested counts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.classify import reconcile_status
from tidemark.operators.extract import scan_path
from tidemark.session import in_parallel

COUNTED = "place int, label string, source string, n long, status string, message string, seconds double"


def count_view(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def _failure(e: Exception) -> tuple[str, str]:
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    return condition or type(e).__name__, str(e).split("\n", 1)[0]


def count_many(
    spark: SparkSession,
    targets: Iterable[tuple[str, str, Sequence[str]]],
    parallel: int = 8,
    read: Callable[[SparkSession, str], DataFrame] = scan_path,
) -> DataFrame:
    """Row counts of `(label, source, columns)` targets, one row each.

    `columns` are columns the source must have, `place` is the place of a target in the list, `read`
    opens a source. All that can be opened are counted in one job. Should a read fail in it,
    every target is counted and timed on its own. A target that cannot be opened or read
    becomes a row with a null count and the first line of its error. `parallel` targets are
    opened, or counted, at a time.
    """

    def opened(item: tuple[int, tuple[str, str, Sequence[str]]]) -> DataFrame | tuple:
        place, (label, source, columns) = item
        try:
            counts = read(spark, source).select(*columns).agg(F.count("*").alias("n"))
            return counts.select(F.lit(place).alias("place"), F.lit(label).alias("label"), F.lit(source).alias("source"), "n")
        except Exception as e:  # any failure of one target belongs to that target
            return place, label, source, None, *_failure(e), None

    def counted(item: tuple[DataFrame, tuple]) -> tuple:
        counts, (place, (label, source, _)) = item
        started = time.monotonic()
        try:
            return (*counts.first(), "OK", None, time.monotonic() - started)
        except Exception as e:
            return place, label, source, None, *_failure(e), time.monotonic() - started

    items = list(enumerate(targets))
    found = in_parallel(spark, opened, items, parallel)
    rows = [r for r in found if not isinstance(r, DataFrame)]
    good = [(r, item) for r, item in zip(found, items) if isinstance(r, DataFrame)]
    if good:
        try:
            together = reduce(DataFrame.unionByName, [df for df, _ in good]).collect()  # one row per target
            rows += [(*r, "OK", None, None) for r in together]
        except Exception:  # some target cannot be read: find out which
            rows += in_parallel(spark, counted, good, parallel)
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), COUNTED)


def count_many_total(counts: DataFrame) -> DataFrame:
    """Views counted, views asked, rows in total and the labels that failed, in input order."""
    failed = F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.struct("place", "label"))))
    return counts.agg(
        F.count("n").alias("ok"),
        F.count("*").alias("targets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.array_join(F.transform(failed, lambda f: f["label"]), ", ").alias("failed"),
    )


def union_counts(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """`(key, expected_rows, row_ingested)`: expected tables with their counts, zero when empty.

    All tables are one tagged DataFrame and one aggregate, not one scan per table. The join is
    between one row per table on both sides.
    """
    counts = rows.groupBy("table").agg(F.count("*").alias("n"))
    return expected.join(counts, "table", "left").select(
        F.col("table").alias("key"),
        "expected_rows",
        F.coalesce("n", F.lit(0)).alias("row_ingested"),
    )


def reconcile_counts(counts: DataFrame) -> DataFrame:
    ingested, expected = F.col("row_ingested"), F.col("expected_rows")
    return counts.withColumns(
        {"diff": ingested - expected, "status": reconcile_status(ingested, expected)}
    )


def order_reconcile(report: DataFrame) -> DataFrame:
    return report.orderBy(F.asc("status"), F.desc("expected_rows"))
