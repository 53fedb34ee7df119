from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times

TEXT_DAYS = [
    (None, None),
    ("", None),
    ("   ", None),
    ("garbage", None),
    ("2026-07-14 05:40:39.340502", "2026-07-14"),
    ("2024-11-18 17:57:50", "2024-11-18"),
    ("  2024-11-18 17:57:50\t ", "2024-11-18"),
    ("2026-08-01", "2026-08-01"),
    ("2026-08-01T00:00:00Z", "2026-08-01"),
    ("2026-08-01T00:00:00.5", "2026-08-01"),
    ("2026-08-01t01:02:03", "2026-08-01"),
    ("2026-8-1 1:02:03", "2026-08-01"),
    ("2026-8-1", "2026-08-01"),
    ("2026-8- 1", "2026-08-01"),
    ("2026-8-1 1:2:3.123456", "2026-08-01"),
    ("2026-8-1   1:2:3", "2026-08-01"),
    ("2026-8-1 1:2:3.1234567", None),
    ("2026-8-1 24:00:00", None),
    ("2026-13-1", None),
    ("2026-2-30", None),
    ("2026-02-30", "2026-02-30"),
    ("2026-02-30 10:00:00", "2026-02-30"),
    ("2026-99-99x", "2026-99-99"),
    ("abcd-ef-gh", "abcd-ef-gh"),
    ("abcd-ef-ghijk", "abcd-ef-gh"),
    ("abcd-ef-g", None),
    ("2026-08-01T10:00:00+02:00", "2026-08-01"),
    ("2026-08-01 10:00:00.123456+02:00", "2026-08-01"),
    ("2026-8-1 10:00:00+02:00", None),
    ("2026-01-Z05", "2026-01-05"),
    ("2026-01-5 1:00:00", "2026-01-05"),
    ("2026-01-5 x", "2026-01-5 "),
    ("2026-1-5\nZ", None),
    ("20260801", None),
    ("99999-01-01", None),
]


def test_day_of_text(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in TEXT_DAYS)), "i int, t string")
    got = dict(df.select("i", times.source_day(F.col("t"))).collect())
    for i, (text, day) in enumerate(TEXT_DAYS):
        assert got[i] == day, text


NUMBER_DAYS = [
    (None, None),
    (0.0, "1970-01-01"),
    (-1.0, "1969-12-31"),
    (1.7e9, "2023-11-14"),
    (1.7e12, "2023-11-14"),
    (1e12, None),  # not above the bound: seconds, far out of range
    (1e12 + 1, "2001-09-09"),
    (86399.0, "1970-01-01"),
    (86399.9999999, "1970-01-02"),
    (253402300799.0, "9999-12-31"),
    (253402300800.0, None),
    (-62135596800.0, "0001-01-01"),
    (-62135596801.0, None),
    (float("nan"), None),
    (float("inf"), None),
    (float("-inf"), None),
]


def test_day_of_number(spark):
    df = spark.createDataFrame(list(enumerate(n for n, _ in NUMBER_DAYS)), "i int, n double")
    got = dict(df.select("i", times.source_day_of_number(F.col("n"))).collect())
    for i, (number, day) in enumerate(NUMBER_DAYS):
        assert got[i] == day, number


@pytest.mark.parametrize("json,day", [
    ('{"DATETIMESTAMP": "2024-01-02 03:04:05"}', "2024-01-02"),
    ('{"datetimestamp": "2024-01-02"}', "2024-01-02"),
    ('{"DATETIMESTAMP": "2024-01-02", "datetimestamp": "2025-01-02"}', "2024-01-02"),
    ('{"DATETIMESTAMP": null, "datetimestamp": "2025-01-02"}', None),
    ('{"DATETIMESTAMP": 1700000000}', "2023-11-14"),
    ('{"DATETIMESTAMP": 1700000000000}', "2023-11-14"),
    ('{"DATETIMESTAMP": 1700000000.75}', "2023-11-14"),
    ('{"DATETIMESTAMP": 1.7e9}', "2023-11-14"),
    ('{"DATETIMESTAMP": true}', "1970-01-01"),
    ('{"DATETIMESTAMP": "1700000000"}', None),
    ('{"DATETIMESTAMP": {"a": 1}}', None),
    ('{"other": 1}', None),
])
def test_day_of_variant(spark, json, day):
    df = spark.createDataFrame([(json,)], "j string").select(F.parse_json("j").alias("c"))
    value = times.field_with_fallback(F.col("c"), "DATETIMESTAMP")
    assert df.select(times.source_day_of_variant(value)).first()[0] == day


def test_parse_ts(spark):
    texts = {
        "2026-07-14 05:40:39.340502": datetime(2026, 7, 14, 5, 40, 39, 340502),
        "2024-11-18 17:57:50": datetime(2024, 11, 18, 17, 57, 50),
        "2024-11-18T17:57:50": None, "2024-11-18": None, "garbage": None, "": None,
        "2024-02-30 00:00:00": None, "2024-1-1 0:0:0": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parsed = F.date_format(times.parse_ts(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    for text, got in df.select("t", parsed).collect():
        want = texts[text]
        assert got == (want.strftime("%Y-%m-%d %H:%M:%S.%f") if want else None), text


def test_parse_ts_equals_trying_both_formats(spark):
    texts = ["2024-01-01 00:00:00", "2024-01-01 00:00:00.1", "2024-01-01 00:00:00.1234567", "2024-01-01 00:00:00.",
             "2024-01-01 00:00", ".", "2024-01-01. 00:00:00", "+12024-01-01 00:00:00", " 2024-01-01 00:00:00", "-1",
             "2024-06-31 00:00:00.000000", "2024-01-01 24:00:00", "2024-01-01 23:59:60.0", None]
    c = F.col("t")
    both = F.coalesce(F.try_to_timestamp(c, F.lit(times.MICROS_FORMAT)), F.try_to_timestamp(c, F.lit(times.SECONDS_FORMAT)))
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    assert df.where(~both.eqNullSafe(times.parse_ts(c))).count() == 0


def test_day_start():
    noon = datetime(2024, 7, 1, 12, tzinfo=timezone.utc)
    assert times.day_start_ms(noon) == 1719792000000
    assert times.day_start_ms(noon, "Europe/Lisbon") == 1719792000000 - 3600_000
    assert times.day_start_ms(noon - timedelta(hours=12.5), "Europe/Lisbon") == 1719792000000 - 3600_000
