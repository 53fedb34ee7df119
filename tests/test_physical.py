"""What the physical plans must and must not contain."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidemark.functions import keys
from tidemark.operators import extract, inspect, load, sink, stats
from tidemark.sources import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The source as files, partitioned by the first ten characters of the incremental field."""
    path = str(tmp_path_factory.mktemp("src") / "events")
    df = views.src_events(spark, SF)
    df.withColumn("day", F.substring("DATETIMESTAMP", 1, 10)).write.partitionBy("day").parquet(path)
    return spark.read.schema(df.withColumn("day", F.lit("")).schema).parquet(path)


def test_mark_reaches_the_scan_and_prunes(stored):
    pruned = extract.incremental_filter(stored, views.START, day_column="day")
    text = plan(pruned)
    assert "PushedFilters: [IsNotNull(DATETIMESTAMP), GreaterThanOrEqual(DATETIMESTAMP,2024-01-15 00:00:00)]" in text
    assert "PartitionFilters: [isnotnull(day" in text
    plain = extract.incremental_filter(stored, views.START)
    assert pruned.exceptAll(plain).count() == plain.exceptAll(pruned).count() == 0
    assert 0 < plain.count() < stored.count()


def test_load_of_a_partitioned_source(spark, stored, tmp_path):
    """The day column prunes partitions and is not part of the row."""
    for name, source, day in (("a", stored, "day"), ("b", stored.drop("day"), None)):
        load.run_load(spark, source, name, f"{tmp_path}/{name}", f"{tmp_path}/s", 0, views.START, day_column=day)
    a, b = (sink.read_table(spark, f"{tmp_path}/{n}") for n in "ab")
    assert a.columns == b.columns
    assert a.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    text = plan(extract.keyed_incremental(stored, views.START, day_column="day"))
    assert "PartitionFilters: [isnotnull(day" in text and "sha2" in text


def test_windows_reach_the_scan(stored):
    as_of = datetime(2025, 1, 15)
    assert "GreaterThanOrEqual(DATETIMESTAMP,2024-01-15 00:00:00)" in plan(extract.window_by_text(stored, as_of))
    parsed = extract.window_by_timestamp(stored, as_of)
    assert "GreaterThanOrEqual(DATETIMESTAMP,2024-01-15 00:00:00)" in plan(parsed)
    from tidemark.functions.times import parse_ts
    exact = stored.where(parse_ts(F.col("DATETIMESTAMP")) >= F.lit("2024-01-15").cast("timestamp"))
    assert parsed.exceptAll(exact).count() == exact.exceptAll(parsed).count() == 0


def test_updated_since_reads_two_columns(spark, tmp_path):
    views.raw_rows(spark, SF).write.parquet(f"{tmp_path}/raw")
    rows = spark.read.parquet(f"{tmp_path}/raw")
    text = plan(stats.rows_updated(stats.updated_since(rows, 5)))
    assert "ReadSchema: struct<table:string,last_updated_time:bigint>" in text
    assert "GreaterThanOrEqual(last_updated_time,5)" in text


def test_keying_is_one_stage_without_shuffle(spark):
    text = plan(keys.with_key(views.table(spark, SF, "lineitem")))
    assert "Exchange" not in text and "Python" not in text and text.count("WholeStageCodegen") <= 1


def test_top_days_limit_before_the_shuffle(spark):
    days = spark.createDataFrame([("t", "d", 1)], "table string, day string, n bigint")
    assert "WindowGroupLimit [table" in plan(stats.top_source_days(days))
    assert ", Partial" in plan(stats.top_source_days(days))


def test_distinct_keys_shuffle_by_key(spark):
    rows = spark.createDataFrame([("t", "k")], "table string, key string")
    exchanges = plan(stats.unique_keys(rows)).split("hashpartitioning(table")[1:]
    assert len(exchanges) == 2 and "key#" in exchanges[1][:30]


def test_a_shared_value_is_sorted_by_several_tasks(spark):
    df = spark.range(0, 20_000, numPartitions=4).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "2026-08-01").otherwise(F.col("id").cast("string")).alias("t"))
    ordered = extract.order_incremental(df, "t")
    spread = ordered.where("t = '2026-08-01'").groupBy(F.spark_partition_id()).count()
    assert [r["t"] for r in ordered.collect()] == sorted(r["t"] for r in df.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spread.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_inspection_shuffles_stored_rows_once(spark, tmp_path):
    rows = spark.range(20).select(
        F.col("id").cast("string").alias("key"), F.lit("2026-08-01 00:00:00").alias("DATETIMESTAMP"), F.lit(1).alias("wide"))
    for name in "ab":
        sink.write_load(rows, f"{tmp_path}/{name}", 0, 10)
    catalog = spark.createDataFrame([("d", n, n, "1") for n in "ab"], "domain string, view string, table string, tier string")
    rows, present, failed = inspect.stored_rows(spark, {n: f"{tmp_path}/{n}" for n in "ab"}, 5)
    found = stats.table_stats(catalog, rows, 5, "2026-08-01", present, failed)
    assert found.collect()[0]["rows_today"] == 20
    text = plan(found)
    final = text[:text.index("Initial Plan")]
    assert "ReusedExchange" in final and "wide" not in final
    assert "GreaterThanOrEqual(last_updated_time,5)" in final


def test_statistics_read_the_rows_twice(spark, tmp_path):
    """Once for the keys and once for the days, which also tell the tables that exist."""
    views.with_source_day(views.raw_rows(spark, SF)).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    spark.range(1).selectExpr("'d' domain", "'V' view", "'tb_click' table", "'1' tier").write.parquet(f"{tmp_path}/c")
    found = stats.table_stats(spark.read.parquet(f"{tmp_path}/c"), rows, 5, "2024-01-20")
    found.collect()
    text = plan(found)
    final = text[:text.index("Initial Plan")]
    assert final.count("FileScan parquet") == 3 and final.count("key#") > 0  # the catalogue is the third
    scans = [line for line in final.split("\n") if "FileScan parquet" in line and "view:string" not in line]
    assert len(scans) == 2 and sum("key:string" in line for line in scans) == 1  # ReadSchema, whatever the folder's length


def test_reading_a_table_sorts_only_rows_of_repeated_keys(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.lit("w" * 50).alias("wide"))
    sink.write_load(rows, f"{tmp_path}/t", 0)
    sink.write_load(rows.limit(5), f"{tmp_path}/t", 1)
    table = sink.read_table(spark, f"{tmp_path}/t")
    assert table.count() == 2000
    table.collect()
    text = plan(table)
    final = text[:text.index("Initial Plan")]
    assert "LeftAnti, BuildRight" in final and "LeftSemi, BuildRight" in final


def test_latest_loads_only(spark, tmp_path):
    for load_id in range(3):
        sink.write_load(spark.range(5).select(F.col("id").cast("string").alias("key")), f"{tmp_path}/t", load_id)
    text = plan(sink.read_table(spark, f"{tmp_path}/t", since_load=2))
    assert "PartitionFilters: [isnotnull(load_id" in text


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_no_product_of_rows(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
