"""Views over the test tables that have the shape of the reference inputs.

They stand for what a deployment reads: source views with a text timestamp, stored rows of many
tables, a catalogue, expected counts, measured volumes and run history. Each is an expression
over a whole table; nothing is made up apart from a few extra catalogue entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import business_key
from tidemark.functions.times import source_day, source_day_of_number

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

START = "2024-01-15 00:00:00"
TODAY = "2024-01-20"
YESTERDAY = "2024-01-19"
TIERED = ("erp",)
# Row bounds of tiers 2 to 5 for the volumes of the test tables.
VOLUME_BOUNDS = (20, 100, 400, 1000)

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SECONDS = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(column: str, n: int):
    return F.col(column) % n == 0


def text_timestamp(df: DataFrame, ts: str, number: str) -> DataFrame:
    """`DATETIMESTAMP`: mostly with fraction, some without, some null, some unparseable."""
    return df.withColumn(
        "DATETIMESTAMP",
        F.when(_mod(number, 97), F.lit(None).cast("string"))
        .when(_mod(number, 101), "garbage")
        .when(_mod(number, 10), F.date_format(ts, SECONDS))
        .otherwise(F.date_format(ts, MICROS)),
    )


def src_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_source(table(spark, sf_dir, "events"))


def events_source(events: DataFrame) -> DataFrame:
    return text_timestamp(events, "ts", "event_id")


def src_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_timestamp(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


def _domain(event_type):
    return (
        F.when(event_type == "signup", "ledger_in")
        .when(event_type == "error", "ledger_na")
        .otherwise("erp")
    )


def _tier(event_type):
    return (
        F.when(event_type == "click", "1").when(event_type == "view", "2")
        .when(event_type == "purchase", "?").otherwise("-")
    )


def _entry(event_type):
    return [
        _domain(event_type).alias("domain"),
        F.upper(event_type).alias("view"),
        F.concat(F.lit("tb_"), event_type).alias("table"),
        _tier(event_type).alias("tier"),
    ]


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of one table per event type, with the source timestamp in many shapes."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    text = (
        F.when(i % 89 == 0, "garbage")
        .when(i % 83 == 0, "abcd-ef-gh tail")
        .when(i % 79 == 0, "2024-02-30 10:00:00")
        .when(i % 73 == 0, "2099-01-01 00:00:00")
        .when(i % 7 == 0, F.date_format("ts", MICROS))
        .when(i % 7 == 1, F.concat(F.lit("  "), F.date_format("ts", SECONDS)))
        .when(i % 7 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(i % 7 == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(i % 7 == 5, F.date_format("ts", "yyyy-M-d H:m:s"))
    )
    number = F.when(i % 2 == 0, ms.cast("double")).otherwise(F.floor(ms / 1000).cast("double"))
    return e.select(
        *_entry(F.col("event_type")),
        F.concat(F.lit("K"), i).alias("key"),
        (ms + (i % 3) * 86_400_000).alias("last_updated_time"),
        text.alias("ts_text"),
        F.when(text.isNull() & (i % 7 == 6), number).alias("ts_num"),
        i.alias("event_id"),
    )


def raw_rows_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`raw_rows` with every fiftieth purchase stored twice under its key."""
    rows = raw_rows(spark, sf_dir)
    again = rows.where((F.col("view") == "PURCHASE") & _mod("event_id", 50))
    return rows.unionByName(again)


def with_source_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "source_day",
        F.coalesce(source_day_of_number(F.col("ts_num")), source_day(F.col("ts_text"))),
    )


def raw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with schemaless columns: the field upper case, lower case, both, null or absent."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    ts = F.date_format("ts", SECONDS)
    upper = F.concat(F.lit('{"DATETIMESTAMP":"'), ts, F.lit('"}'))
    text = (
        F.when(i % 5 == 0, upper)
        .when(i % 5 == 1, F.concat(F.lit('{"datetimestamp":"'), ts, F.lit('"}')))
        .when(i % 5 == 2, F.concat(F.lit('{"DATETIMESTAMP":null,"datetimestamp":"'), ts, F.lit('"}')))
        .when(i % 5 == 3, F.concat(F.lit('{"DATETIMESTAMP":'), i + 1_700_000_000, F.lit("}")))
        .otherwise('{"other":1}')
    )
    return e.select("event_id", F.parse_json(text).alias("columns"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per event type, and tables that are absent, gone or locked."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    more = spark.createDataFrame(
        [("erp", "ABSENT", "tb_absent", "3"), ("erp", "GONE", "tb_gone", "2"),
         ("ledger_in", "LOCKED", "tb_locked", "-")],
        "domain string, view string, table string, tier string",
    )
    return kinds.select(*_entry(F.col("event_type"))).unionByName(more)


def failures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("tb_gone", "HTTP 404: no such table"), ("tb_locked", "permission denied")],
        "table string, message string",
    )


def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True counts per table: some equal, one lower, one higher, one table empty and one without rows."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    shift = F.when(F.col("event_type") == "click", 5).when(F.col("event_type") == "view", -5).otherwise(0)
    true = counts.select(
        F.concat(F.lit("tb_"), "event_type").alias("table"), (F.col("n") + shift).alias("expected_rows")
    )
    more = spark.createDataFrame(
        [("tb_absent", 7), ("tb_empty", 0)], "table string, expected_rows bigint"
    )
    return true.unionByName(more)


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured row counts of named tables: line items by return flag, year and size of price.

    The sizes span several orders of magnitude and the number of names depends on the calendar
    and the price range, not on the scale. Some are left uncounted.
    """
    size = F.length(F.bin(F.floor("l_extendedprice")))
    counts = table(spark, sf_dir, "lineitem").groupBy(
        "l_returnflag", F.year("l_shipdate").alias("y"), size.alias("b")
    ).agg(F.count("*").alias("n"))
    named = counts.select(
        F.concat("l_returnflag", F.col("y").cast("string"), F.lit("S"), F.col("b").cast("string")).alias("name"),
        F.when((F.col("l_returnflag") == "A") & (F.col("b") == 12), F.lit(None)).otherwise(F.col("n")).alias("n"),
    )
    return named.withColumn("place", F.col("name"))


def business_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the key of order and line number, which is not unique."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(business_key("l_orderkey", "l_linenumber").alias("key"), "*")
