"""Inspection and reconciliation of tables that loads have stored."""

import pytest

from tidemark.operators import inspect, load, reconcile, sink

START = "2026-08-01 00:00:00"
DAY = 1_785_715_200_000  # 2026-08-03 UTC
SCHEMA = "id int, DATETIMESTAMP string"


def test_inspection_of_stored_tables(spark, tmp_path):
    root = str(tmp_path)

    def store(table, load_id, at, *rows):
        df = spark.createDataFrame(list(rows), SCHEMA)
        load.run_load(spark, df, table, f"{root}/{table}", f"{root}/state", load_id, START, updated_ms=at)

    store("a", 0, DAY - 1, (1, "2026-08-02 23:00:00"), (2, "2026-08-02 23:30:00"))
    store("a", 1, DAY + 1, (2, "2026-08-02 23:30:00"), (3, "2026-08-03 00:00:01"))
    store("b", 0, DAY + 1, (1, "2026-08-01 01:00:00"), (2, "2026-08-02 01:00:00"), (3, "garbage"))
    store("b", 1, DAY + 2, (2, "2026-08-02 01:00:00"))
    store("idle", 0, DAY - 1, (1, "2026-08-01 01:00:00"))
    (tmp_path / "broken" / "load_id=0").mkdir(parents=True)
    (tmp_path / "broken" / "load_id=0" / "x.parquet").write_bytes(b"nothing")
    names = ["a", "b", "idle", "absent", "broken"]
    catalog = spark.createDataFrame(
        [("erp", n.upper(), n, "1") for n in names], "domain string, view string, table string, tier string")
    paths = {n: f"{root}/{n}" for n in names}

    got = {r["table"]: r for r in inspect.inspect_tables(spark, catalog, paths, DAY, "2026-08-03").collect()}
    assert (got["a"]["rows_today"], got["a"]["source_day_today"], got["a"]["source_day_before"]) == (2, 1, 1)
    assert got["a"]["flag"] == ""
    # the row stored again by the second load counts once
    assert (got["b"]["rows_today"], got["b"]["source_day_before"], got["b"]["source_day_missing"]) == (3, 2, 1)
    assert got["b"]["flag"] == "~re-upsert/catch-up"
    assert (got["idle"]["status"], got["idle"]["rows_today"]) == ("OK", 0)
    assert got["absent"]["status"] == "MISSING"
    assert got["broken"]["status"] == "ERROR" and got["broken"]["error"]

    rows, present, failures = inspect.stored_rows(spark, paths)
    assert sorted(r[0] for r in present.collect()) == ["a", "b", "idle"]
    assert [r["table"] for r in failures.collect()] == ["broken"]
    expected = spark.createDataFrame([("a", 3), ("b", 4), ("idle", 1), ("absent", 2)], "table string, expected_rows bigint")
    report = reconcile.reconcile_counts(reconcile.union_counts(expected, rows))
    assert {r["key"]: (r["row_ingested"], r["status"]) for r in report.collect()} == {
        "a": (3, "OK"), "b": (3, "MISSING"), "idle": (1, "OK"), "absent": (0, "EMPTY")}


def test_inspection_of_variant_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-08-03 01:00:00"), (2, "2026-08-02 01:00:00"), (3, "garbage")], SCHEMA)
    load.run_load(spark, df, "v", f"{tmp_path}/v", f"{tmp_path}/s", 0, START, updated_ms=DAY, as_variant=True)
    lower = df.withColumnRenamed("DATETIMESTAMP", "datetimestamp").selectExpr("string(id) key", "*")
    sink.write_load(sink.schemaless(lower), f"{tmp_path}/w", 0, DAY)
    seconds = spark.sql("select 'k' key, 1785715200.5D as DATETIMESTAMP")
    sink.write_load(seconds, f"{tmp_path}/n", 0, DAY)
    catalog = spark.createDataFrame([("erp", t, t, "1") for t in "vwn"], "domain string, view string, table string, tier string")
    found = inspect.inspect_tables(spark, catalog, {t: f"{tmp_path}/{t}" for t in "vwn"}, DAY, "2026-08-03")
    got = {r["table"]: (r["source_day_today"], r["source_day_before"], r["source_day_missing"]) for r in found.collect()}
    assert got == {"v": (1, 1, 1), "w": (1, 1, 1), "n": (1, 0, 0)}


def test_lower_case_field_and_field_gained_later(spark, tmp_path):
    today = spark.createDataFrame([("k1", "2026-08-03 01:00:00"), ("k2", "2026-08-02 01:00:00")], "key string, DATETIMESTAMP string")
    sink.write_load(today.withColumnRenamed("DATETIMESTAMP", "datetimestamp"), f"{tmp_path}/low", 0, DAY)
    sink.write_load(today.selectExpr("concat(key, 'x') key", "1 other"), f"{tmp_path}/late", 0, DAY)
    sink.write_load(today, f"{tmp_path}/late", 1, DAY)
    catalog = spark.createDataFrame([("erp", t, t, "1") for t in ("low", "late")], "domain string, view string, table string, tier string")
    found = inspect.inspect_tables(spark, catalog, {t: f"{tmp_path}/{t}" for t in ("low", "late")}, DAY, "2026-08-03")
    got = {r["table"]: (r["source_day_today"], r["source_day_before"], r["source_day_missing"]) for r in found.collect()}
    assert got == {"low": (1, 1, 0), "late": (1, 1, 2)}


@pytest.mark.parametrize("exact", ["false", "true"])
def test_field_that_changes_its_case_between_loads(spark, tmp_path, exact):
    rows = spark.createDataFrame([("k1", "2026-08-03 01:00:00")], "key string, DATETIMESTAMP string")
    lower = spark.createDataFrame([("k2", "2026-08-02 01:00:00"), ("k3", None)], "key string, datetimestamp string")
    path = f"{tmp_path}/t"
    catalog = spark.createDataFrame([("erp", "t", "t", "1")], "domain string, view string, table string, tier string")
    spark.conf.set("spark.sql.caseSensitive", exact)
    try:
        sink.write_load(lower, path, 0, DAY)
        sink.write_load(rows, path, 1, DAY)
        for fold in (False, True):
            if fold:
                sink.compact(spark, path)
                sink.write_load(lower.limit(1).selectExpr("'k4' key", "datetimestamp"), path, 2, DAY)
            r = inspect.inspect_tables(spark, catalog, {"t": path}, DAY, "2026-08-03").first()
            assert (r["status"], r["rows_today"], r["source_day_today"], r["source_day_before"], r["source_day_missing"]) \
                == ("OK", 3 + fold, 1, 1 + fold, 1)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_a_damaged_file_concerns_its_table_alone(spark, tmp_path):
    rows = spark.createDataFrame([("k", "2026-08-03 01:00:00")], "key string, DATETIMESTAMP string")
    for name in ("good", "bad"):
        sink.write_load(rows, f"{tmp_path}/{name}", 0, DAY)
    (tmp_path / "bad" / "load_id=0" / "x.parquet").write_bytes(b"nothing")
    catalog = spark.createDataFrame([("erp", t, t, "1") for t in ("good", "bad")], "domain string, view string, table string, tier string")
    paths = {t: f"{tmp_path}/{t}" for t in ("good", "bad")}
    got = {r["table"]: (r["status"], r["rows_today"], bool(r["error"])) for r in inspect.inspect_tables(
        spark, catalog, paths, DAY, "2026-08-03").collect()}
    assert got == {"good": ("OK", 1, False), "bad": ("ERROR", 0, True)}
    counts = {r["label"]: (r["n"], r["status"] == "OK") for r in reconcile.count_many(
        spark, [(t, p, ("key",)) for t, p in paths.items()]).collect()}
    assert counts == {"good": (1, True), "bad": (None, False)}


def test_nothing_stored(spark, tmp_path):
    rows, present, failures = inspect.stored_rows(spark, {"a": f"{tmp_path}/a"}, DAY)
    assert rows.count() == present.count() == failures.count() == 0
    assert set(rows.columns) == {"table", "key", sink.UPDATED, "source_day"}
