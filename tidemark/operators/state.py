"""High-water marks: the last incremental value read, per query."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import parse_ts
from tidemark.operators.extract import INCREMENTAL_FIELD, INITIAL_START


# A mark as stored: one row in a folder per query and slot.
MARK = "high_water string, load_id bigint, query string, slot int"


def mark_value(field: str | Column = INCREMENTAL_FIELD, well_formed_only: bool = True) -> Column:
    """The next mark: the greatest value of the field, as text.

    Text that is no timestamp passes the incremental filter and sorts after every date. Taken
    as a mark it would stop the query for good, so by default only well-formed values count.
    """
    column = F.col(field) if isinstance(field, str) else field
    return F.max(F.when(parse_ts(column).isNotNull(), column) if well_formed_only else column)


def advance(
    state: DataFrame,
    batch: DataFrame,
    query: str = "query",
    field: str = INCREMENTAL_FIELD,
    initial_start: str = INITIAL_START,
    well_formed_only: bool = True,
) -> DataFrame:
    """`(query, high_water)` after a batch: never lower than before, the start when unset.

    The batch is reduced to one row per query before the join.
    """
    seen = batch.groupBy(query).agg(mark_value(field, well_formed_only).alias("seen"))
    return state.join(seen, query, "full_outer").select(
        query,
        F.greatest(F.coalesce("high_water", F.lit(initial_start)), "seen").alias("high_water"),
    )


def _slots(spark: SparkSession, path: str, query: str | None = None) -> DataFrame | None:
    folder = path if query is None else f"{path}/query={query}"
    try:
        return spark.read.schema(MARK).option("basePath", path).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_marks(spark: SparkSession, path: str) -> DataFrame | None:
    """The current mark of every query, with the load that set it."""
    slots = _slots(spark, path)
    if slots is None:
        return None
    last = F.max(F.struct("load_id", "high_water")).alias("last")
    return slots.groupBy("query").agg(last).select("query", "last.*")


def last_mark(
    spark: SparkSession, path: str, query: str, before_load: int | None = None
) -> Row | None:
    """The stored mark of one query and its slot.

    `before_load` gives the mark as that load found it, for the case that it is repeated: from
    the mark its first attempt has set, rows that only that attempt read would be lost.
    """
    slots = _slots(spark, path, query)
    rows = [] if slots is None else slots.collect()  # two at most
    rows = [r for r in rows if before_load is None or r["load_id"] < before_load]
    return max(rows, key=lambda r: r["load_id"], default=None)


def read_mark(
    spark: SparkSession,
    path: str,
    query: str,
    initial_start: str = INITIAL_START,
    before_load: int | None = None,
) -> str:
    """The mark of one query, the start when there is none."""
    last = last_mark(spark, path, query, before_load)
    return initial_start if last is None else last["high_water"]


def write_mark(
    spark: SparkSession, path: str, query: str, high_water: str, load_id: int, last: Row | None
) -> None:
    """Set the mark of one query; `last` is the `last_mark` before this load.

    A query has two slots and a load writes the one that does not hold the mark before it. So the
    state stays two rows per query, and a write that fails leaves the earlier mark in place.
    """
    slot = 0 if last is None else 1 - last["slot"]
    row = spark.range(1).select(
        F.lit(high_water).alias("high_water"), F.lit(load_id).cast("long").alias("load_id")
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/query={query}/slot={slot}")


def late_rows(df: DataFrame, mark: str | Column, field: str = INCREMENTAL_FIELD) -> DataFrame:
    """Rows below the stored mark: no later load will read them."""
    return df.where(F.col(field) < (F.lit(mark) if isinstance(mark, str) else mark))
