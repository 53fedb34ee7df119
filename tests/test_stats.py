"""Daily inspection, reconciliation and history on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify
from tidemark.operators import history, reconcile, stats

TODAY, SINCE = "2024-01-20", 1000
CATALOG = "domain string, view string, table string, tier string"
ROWS = "table string, key string, last_updated_time bigint, source_day string"


@pytest.fixture(scope="module")
def inspected(spark):
    catalog = spark.createDataFrame([
        ("erp", "NEW", "tb_new", "1"), ("erp", "OLD", "tb_old", "1"), ("erp", "DUP", "tb_dup", "2"),
        ("erp", "EVEN", "tb_even", "2"), ("erp", "IDLE", "tb_idle", "?"), ("erp", "GONE", "tb_gone", "?"),
        ("ledger", "BAD", "tb_bad", "-"), ("ledger", "FOUND", "tb_404", "-"), ("ledger", "NULLS", "tb_nulls", "-"),
    ], CATALOG)
    rows = [("tb_new", f"n{i}", 1000 + i, TODAY) for i in range(5)]
    rows += [("tb_new", "older", 999, TODAY)]
    rows += [("tb_old", f"o{i}", 2000, d) for i, d in enumerate([TODAY, "2024-01-19", "2099-01-01"])]
    rows += [("tb_dup", "same", 2000, "2024-01-01"), ("tb_dup", "same", 2000, "2024-01-02")]
    rows += [("tb_even", "a", 2000, TODAY), ("tb_even", "b", 2000, "2024-01-01"), ("tb_even", "c", 2000, None)]
    rows += [("tb_idle", "i", 1, TODAY)]
    rows += [("tb_bad", "x", 5000, TODAY), ("tb_other", "y", 5000, TODAY)]
    rows += [("tb_nulls", f"k{i}", 2000, d) for i, d in enumerate([None, None, "2024-01-03", "2024-01-02", "2024-01-01"])]
    failures = spark.createDataFrame(
        [("tb_bad", "timed out"), ("tb_404", "Table Not Found: tb_404")], "table string, message string")
    return stats.table_stats(
        catalog, spark.createDataFrame(rows, ROWS), SINCE, TODAY, failures=failures).cache()


def test_table_stats(inspected):
    got = {r["table"]: r for r in inspected.collect()}
    assert len(got) == 9  # one per entry; tb_other is in no catalogue

    def counters(t):
        r = got[t]
        return (r["rows_today"], r["unique_keys"], r["source_day_today"], r["source_day_before"],
                r["source_day_missing"], r["status"], r["flag"])

    assert counters("tb_new") == (5, 5, 5, 0, 0, "OK", "")
    assert counters("tb_old") == (3, 3, 1, 2, 0, "OK", "~re-upsert/catch-up")  # later days count as before
    assert counters("tb_dup") == (2, 1, 0, 2, 0, "OK", "!DUP_KEYS")  # duplicates win over catch-up
    assert counters("tb_even") == (3, 3, 1, 1, 1, "OK", "")  # strictly more before than today
    assert counters("tb_idle") == (0, 0, 0, 0, 0, "OK", "")
    assert counters("tb_gone") == (0, 0, 0, 0, 0, "MISSING", "")
    assert counters("tb_bad") == (0, 0, 0, 0, 0, "ERROR", "")
    assert counters("tb_404") == (0, 0, 0, 0, 0, "MISSING", "")
    assert got["tb_bad"]["error"] == "timed out" and got["tb_new"]["error"] is None
    top = [(t["day"], t["n"]) for t in got["tb_nulls"]["top_source_days"]]
    assert top == [("<missing>", 2), ("2024-01-01", 1), ("2024-01-02", 1)]


def test_rollups(inspected):
    by_domain = {r["domain"]: r.asDict() for r in stats.summary_by_domain(inspected).collect()}
    assert by_domain["erp"] == {
        "domain": "erp", "tables": 6, "ok": 5, "missing": 1, "errors": 0, "upd_today": 13, "src_today": 7,
        "src_old": 5, "dup_keys": 1, "reupsert": 1}
    assert by_domain["ledger"]["errors"] == 1 and by_domain["ledger"]["missing"] == 1
    by_tier = {r["tier"]: r[1:] for r in stats.summary_by_tier(inspected, ["erp"]).collect()}
    assert by_tier == {"1": (2, 8, 6, 2), "2": (2, 5, 1, 3), "?": (2, 0, 0, 0)}
    ordered = stats.tier_sort(stats.summary_by_tier(inspected, ["erp"]))
    assert [r["tier"] for r in ordered.collect()] == ["1", "2", "?"]
    assert stats.run_totals(inspected).first()[:] == (9, 18, 3)


def test_row_class(inspected):
    got = dict(inspected.select(
        "table", classify.report_row_class(F.col("status"), F.col("flag"))).collect())
    assert got["tb_bad"] == got["tb_gone"] == "err" and got["tb_dup"] == "warn"
    assert got["tb_old"] == "catchup" and got["tb_even"] == ""


@pytest.mark.parametrize("ingested,expected,status", [
    (5, 5, "OK"), (0, 0, "OK"), (0, 5, "EMPTY"), (4, 5, "MISSING"), (6, 5, "EXTRA"), (1, 0, "EXTRA"),
])
def test_reconcile_status(spark, ingested, expected, status):
    df = spark.createDataFrame([(ingested, expected)], "i int, e int")
    assert df.select(classify.reconcile_status(F.col("i"), F.col("e"))).first()[0] == status


def test_report_order(spark):
    rows = spark.createDataFrame(
        [("a", 5, 5), ("b", 9, 9), ("c", 7, 0), ("d", 1, 2)], "key string, expected_rows int, row_ingested int")
    report = reconcile.order_reconcile(reconcile.reconcile_counts(rows))
    assert [(r["key"], r["status"], r["diff"]) for r in report.collect()] == [
        ("c", "EMPTY", -7), ("d", "EXTRA", 1), ("b", "OK", 0), ("a", "OK", 0)]


def test_count_many_confines_failures(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/good")
    spark.range(3).write.parquet(f"{tmp_path}/broken")
    part = next(p for p in (tmp_path / "broken").iterdir() if p.suffix == ".parquet")
    part.write_bytes(b"no parquet")
    targets = [("good", f"{tmp_path}/good", ("id",)), ("absent", f"{tmp_path}/absent", ()),
               ("broken", f"{tmp_path}/broken", ()), ("column", f"{tmp_path}/good", ("nope",))]
    counts = reconcile.count_many(spark, targets)
    got = {r["label"]: (r["n"], r["status"]) for r in counts.collect()}
    assert got["good"] == (7, "OK") and got["absent"] == (None, "PATH_NOT_FOUND")
    assert got["broken"][0] is None and got["column"][1].startswith("UNRESOLVED_COLUMN")
    assert all((r["seconds"] or 0) >= 0 for r in counts.collect())
    assert all("\n" not in (r["message"] or "") for r in counts.collect())
    total = reconcile.count_many_total(counts).first()
    assert total[:] == (1, 4, 7, "absent, broken, column")
    none = reconcile.count_many_total(reconcile.count_many(spark, [])).first()
    assert none[:] == (0, 0, 0, "")


def test_history(spark, tmp_path, inspected):
    path = f"{tmp_path}/history"
    by_domain = stats.summary_by_domain(inspected)
    for seq, day in ((1, "2024-01-18"), (2, "2024-01-19"), (3, "2024-01-25"), (4, TODAY)):
        history.append_history(history.history_entry(
            inspected, ["erp"], seq, day, f"{day}T00:00:00Z", {"database": "raw"}), path)
    (tmp_path / "history" / "extra.json").write_text('\n   \n{"seq": 9, "day": "cut\nnot json\n')
    entries = history.read_history(spark, path)
    assert sorted(r["seq"] for r in entries.collect()) == [1, 2, 3, 4]
    previous = history.history_previous(entries, TODAY)
    assert previous.first()["day"] == "2024-01-25"  # the last line of another day, later days included
    changed = by_domain.withColumn("upd_today", F.col("upd_today") + F.when(F.col("domain") == "erp", 3).otherwise(0))
    more = changed.unionByName(by_domain.where("domain = 'erp'").withColumn("domain", F.lit("new")))
    delta = {r["domain"]: r["delta"] for r in history.day_over_day_delta(more, previous).collect()}
    assert delta == {"erp": "+3", "ledger": "+0", "new": ""}
    assert history.history_previous(entries.where("seq = 4"), TODAY).count() == 0
    files = [p for p in (tmp_path / "history").glob("part*.json") if p.stat().st_size]
    line = json.loads(files[0].read_text())
    assert set(line["summary"]) == {"by_domain", "by_tier"} and line["database"] == "raw"
    assert len(line["tables"]) == 9 and line["tables"][0]["table"] == "tb_dup"


def test_history_without_sequence_numbers_goes_by_line(spark, tmp_path):
    """One file of lines, as another writer may have left it."""
    days = ["2024-01-17", "2024-01-25", "2024-01-18", TODAY]
    text = [json.dumps({"day": d, "summary": {"by_domain": {"erp": {"upd_today": i}}}}) for i, d in enumerate(days)]
    (tmp_path / "history.jsonl").write_text("\n".join(["", *text[:2], "{broken", *text[2:], " "]) + "\n")
    previous = history.history_previous(history.read_history(spark, f"{tmp_path}/history.jsonl"), TODAY).first()
    assert previous["day"] == "2024-01-18" and previous["summary"]["by_domain"]["erp"]["upd_today"] == 2


@pytest.mark.parametrize("message,want", [
    ("('42P01', 'x')", "missing_object"), ("[TABLE_OR_VIEW_NOT_FOUND] v", "missing_object"),
    ("('42703', 'x')", "unresolved_column"), ("[UNRESOLVED_COLUMN.WITH_SUGGESTION]", "unresolved_column"),
    ("timed out", "other"),
])
def test_error_class(spark, message, want):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(classify.error_class(F.col("m"))).first()[0] == want
