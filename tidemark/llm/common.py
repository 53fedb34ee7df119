"""Shared folder, shipped code, binary files and row helpers of the operators in this package."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_KEPT: dict[tuple, Any] = {}
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that functions in it can be unpickled there.

    Also lowers the rows of an Arrow batch from Spark's default, which is made for short rows: batches of whole
    documents exist several times in an executor and its workers.
    """
    if int(spark.conf.get(BATCH, "10000")) == 10_000:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    stem = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(package)}_{app.replace('-', '_')}")
    archive = shutil.make_archive(stem, "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below ``spark.checkpoint.dir``, which all executors share.

    Only a local session may lack the setting; it then gets a temporary folder of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts lineage and keeps results of Python stages."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(path: str, data: bytes) -> None:
    """Put ``data`` at ``path`` in one step, so that a repeated task replaces its file and none is half written."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(place), recursive=True)
        with store.open_output_stream(part := f"{place}.{uuid.uuid4().hex}.part") as out:
            out.write(data)
        store.move(part, place)
        return
    place = local_path(path)
    os.makedirs(os.path.dirname(place), exist_ok=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, place)


def local_path(path: str) -> str:
    """``file:`` URIs as plain paths."""
    if not path.startswith("file:"):
        return path
    return "/" + path.removeprefix("file:").lstrip("/")


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Path and content of the files of a folder, by Spark's own reader."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
    return reader.load(folder).select("path", "content")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that working memory depends on few texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The object of a key, made once per worker. A worker keeps one such object at a time.

    Workers live on from stage to stage; the word tables of several operators together would not fit beside each
    other.
    """
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Return freed memory to the system, which the allocators otherwise hold for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Let each query's shuffle files go when it has ended, for steps that write what they have made."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
