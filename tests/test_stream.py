"""The continuous load, over arriving files and over a polled view."""

import time

import pytest

from tidemark.operators import sink, state
from tidemark.streaming import continuous

START = "2026-08-01 00:00:00"
SCHEMA = "id int, v string, DATETIMESTAMP string"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def arrive(spark, root, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def run_once(spark, root):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = continuous.read_stream(spark, f"{root}/in", schema, files_per_trigger=1)
    q = continuous.start_load(
        stream, "q", f"{root}/t", f"{root}/s", f"{root}/c", START, once=True, now_ms=lambda: 5,
        rows_per_file=1)
    q.awaitTermination()
    return sorted(r["id"] for r in sink.read_table(spark, f"{root}/t").collect())


def test_files_arrive_over_several_runs(spark, root):
    arrive(spark, root, (1, "a", "2026-08-01 00:00:00"), (2, "b", "2026-07-01 00:00:00"), (3, "c", None))
    assert run_once(spark, root) == [1]
    assert run_once(spark, root) == [1]
    # the same row again, a new version of it, a late row and a new row
    arrive(spark, root, (1, "a", "2026-08-01 00:00:00"), (1, "A", "2026-08-03 00:00:00"), (5, "e", "2026-08-04 00:00:00"))
    assert run_once(spark, root) == [1, 1, 5]
    # a row below the mark is in a new file, so no earlier batch has seen it
    arrive(spark, root, (6, "late", "2026-08-03 00:00:00"), (7, "g", "2026-08-04 00:00:00"))
    assert run_once(spark, root) == [1, 1, 5, 6, 7]
    assert state.read_mark(spark, f"{root}/s", "q") == "2026-08-04 00:00:00"


def test_files_in_reverse_order_one_at_a_time(spark, root):
    for day in (9, 5, 3, 1):
        arrive(spark, root, (day, "a", f"2026-08-0{day} 00:00:00"), (day + 10, "old", "2026-07-01 00:00:00"))
    assert run_once(spark, root) == [1, 3, 5, 9]
    assert state.read_mark(spark, f"{root}/s", "q") == "2026-08-09 00:00:00"


def test_stream_goes_on_after_a_compaction(spark, root):
    arrive(spark, root, (1, "a", "2026-08-01 00:00:00"))
    run_once(spark, root)
    sink.compact(spark, f"{root}/t")
    arrive(spark, root, (2, "b", "2026-08-02 00:00:00"))
    assert run_once(spark, root) == [1, 2]


def test_a_repeated_batch_stores_the_same_rows(spark, root, monkeypatch):
    """The run dies after the mark has moved and before the batch is committed."""
    real, fail = continuous.run_load, {"on": True}

    def dying(*args, **kw):
        out = real(*args, **kw)
        if fail["on"]:
            raise RuntimeError("driver lost")
        return out

    monkeypatch.setattr(continuous, "run_load", dying)
    arrive(spark, root, (1, "a", "2026-08-01 00:00:00"), (2, "b", "2026-08-09 00:00:00"))
    with pytest.raises(Exception):
        run_once(spark, root)
    assert state.read_mark(spark, f"{root}/s", "q") == "2026-08-09 00:00:00"
    fail["on"] = False
    assert run_once(spark, root) == [1, 2]


def test_polled_view(spark, root):
    arrive(spark, root, (1, "a", "2026-08-01 00:00:00"))
    q = continuous.start_polling(
        spark, lambda: spark.read.schema(SCHEMA).parquet(f"{root}/in"), "polled", f"{root}/t", f"{root}/s",
        f"{root}/c", START, interval="1 second")
    try:
        def wait(n):
            for _ in range(60):
                df = sink.read_table(spark, f"{root}/t")
                if df is not None and df.count() == n:
                    return True
                time.sleep(0.5)
            return False

        assert wait(1)
        arrive(spark, root, (2, "b", "2026-08-02 00:00:00"))
        assert wait(2)
    finally:
        q.stop()


def test_extractor_goes_through_its_sources(spark, root):
    from tidemark.sources import catalogue
    picked = [s for s in catalogue.sources("ledger_in") if s.view in ("F0010", "F4108")]
    arrive(spark, root, (1, "a", "2026-08-01 00:00:00"))

    def read(s):
        return spark.table("absent") if s.view == "F4108" else spark.read.schema(SCHEMA).parquet(f"{root}/in")

    q = continuous.start_extractor(
        spark, "x", picked, read, f"{root}/raw", f"{root}/s", f"{root}/ledger", f"{root}/c", START, interval="1 second",
        parallel=2, as_variant=True)
    try:
        for _ in range(120):
            runs = sink.read_loads(spark, f"{root}/ledger")
            if runs is not None and runs.select("load_id").distinct().count() >= 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    rows = {(r["load_id"], r["query"]): (r["status"], r["rows"]) for r in runs.collect()}
    assert rows[0, "extract-ledger_in-F0010"] == rows[1, "extract-ledger_in-F0010"] == ("success", 1)
    assert rows[1, "extract-ledger_in-F4108"] == ("failure", None)
    stored = sink.read_table(spark, f"{root}/raw/ledger_in/F0010")
    assert stored.count() == 1 and "columns" in stored.columns
