"""Continuous keyed load of a growing source with Structured Streaming.

`options` of the functions are further arguments of `run_load`, or of `load_sources`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.extract import INCREMENTAL_FIELD, INITIAL_START
from tidemark.operators.load import run_load
from tidemark.operators.sink import write_load
from tidemark.plans.jobs import Reader, load_sources
from tidemark.sources.catalogue import Source

# Fixed value: the interval between two loads of a query.
INTERVAL = "15 minutes"


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New files of a folder or pattern; `files_per_trigger` bounds one micro-batch.

    Files are taken in order of arrival. However they are dealt to batches, and in whatever order
    their rows come, the same rows are loaded.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _start(stream, load, query: str, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    writer = stream.writeStream.queryName(query).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.foreachBatch(load).start()


def start_load(
    stream: DataFrame,
    query: str,
    sink: str,
    state: str,
    checkpoint: str,
    initial_start: str = INITIAL_START,
    field: str = INCREMENTAL_FIELD,
    once: bool = False,
    interval: str = INTERVAL,
    now_ms: Callable[[], int] = lambda: int(time.time() * 1000),
    **options,
) -> StreamingQuery:
    """Load every micro-batch: rows at or after the initial start, keyed, stored, mark moved.

    The checkpoint knows which files are new, so the mark need not tell and leaves no row out; it
    only records how far the load has come. The batch number is the load number. A batch
    repeated after a failure replaces its own rows and moves the mark as before. `once`
    takes what is there and stops; otherwise a batch starts every interval, or when the one
    before has finished if that took longer.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        run_load(
            batch.sparkSession, batch, query, sink, state, batch_id, initial_start, field, now_ms(),
            new_rows_only=True, **options,
        )

    return _start(stream, load, query, checkpoint, once, interval)


def start_polling(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    query: str,
    sink: str,
    state: str,
    checkpoint: str,
    initial_start: str = INITIAL_START,
    field: str = INCREMENTAL_FIELD,
    interval: str = INTERVAL,
    now_ms: Callable[[], int] = lambda: int(time.time() * 1000),
    **options,
) -> StreamingQuery:
    """The same for a view, which has no files to watch: read it again at every trigger.

    The streaming source only serves as the clock that numbers the loads; the rows are those of
    `read()` at or after the mark. Rows that appear below it later are not loaded (`late_rows`).
    """

    def load(_: DataFrame, batch_id: int) -> None:
        run_load(
            spark, read(), query, sink, state, batch_id, initial_start, field, now_ms(), **options
        )

    return _start(_clock(spark), load, query, checkpoint, False, interval)


def _clock(spark: SparkSession) -> DataFrame:
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()


def start_extractor(
    spark: SparkSession,
    name: str,
    sources: Sequence[Source],
    read: Reader,
    sink_root: str,
    state: str,
    ledger: str,
    checkpoint: str,
    initial_start: str = INITIAL_START,
    interval: str = INTERVAL,
    now_ms: Callable[[], int] = lambda: int(time.time() * 1000),
    **options,
) -> StreamingQuery:
    """All sources of one extractor, one after the other at every trigger, in the given order.

    A source that fails is recorded in the ledger and tried again at the next trigger.
    """

    def load(_: DataFrame, batch_id: int) -> None:
        run = load_sources(
            spark, sources, read, sink_root, state, batch_id, initial_start, now_ms(), **options
        )
        write_load(run.coalesce(1), ledger, batch_id)

    return _start(_clock(spark), load, name, checkpoint, False, interval)
