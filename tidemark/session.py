"""Session settings the library relies on, and where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


SHARED = "spark.checkpoint.dir"
Item = TypeVar("Item")
Result = TypeVar("Result")


def configure(spark: SparkSession) -> SparkSession:
    """Pin the time zone, for times printed in results; on a local session, give it a shared folder.

    Keys do not depend on the zone. A cluster names its own folder in `spark.checkpoint.dir`.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if not _shared(spark) and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark


def _shared(spark: SparkSession) -> str | None:
    return spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder, which must be set."""
    base = _shared(spark)
    if not base:
        raise ValueError(f"set {SHARED} to a folder all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def in_parallel(
    spark: SparkSession, fn: Callable[[Item], Result], items: Iterable[Item], parallel: int
) -> list[Result]:
    """`fn` of every item in order, `parallel` at a time: for many small jobs on many tables."""
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))
