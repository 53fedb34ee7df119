"""Load planning against the recorded volumes, totals, split and order."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.operators.extract import SAMPLE_ROWS
from tidemark.functions import classify
from tidemark.plans import jobs, load_plan
from tidemark.session import configure
from tidemark.sources import catalogue


@pytest.fixture(scope="module")
def erp():
    return catalogue.sources("erp")


@pytest.fixture(scope="module")
def tables(spark, erp):
    return jobs.plan_rows(spark, erp)


def test_catalogue(erp):
    assert [len(catalogue.sources(d)) for d in ("erp", "ledger_in", "ledger_na")] == [149, 15, 30]
    assert len({(s.domain, s.view) for s in catalogue.catalogue()}) == 194
    assert Counter(s.load for s in erp) == {"full": 51, "text": 33, "timestamp": 65}
    assert sum(s.sampled for s in catalogue.catalogue()) == 65 + 30
    assert {s.view for s in erp if s.rows is None} == set(catalogue.UNCOUNTED.split())
    widths = Counter(len(s.key_columns) for s in catalogue.catalogue())
    assert max(widths) == 14 and widths[1] == 11


def test_tiers_follow_from_volumes(tables):
    wrong = tables.where(classify.tier_of_volume(F.col("n")) != F.col("tier"))
    assert wrong.count() == 0


@pytest.mark.parametrize("rows,tier", [
    (0, "1"), (999_999, "1"), (1_000_000, "2"), (9_999_999, "2"), (10_000_000, "3"), (100_000_000, "4"),
    (999_999_999, "4"), (1_000_000_000, "5"), (None, "?"),
])
def test_tier_bounds_are_half_open(spark, rows, tier):
    df = spark.createDataFrame([(rows,)], "n bigint")
    assert df.select(classify.tier_of_volume(F.col("n"))).first()[0] == tier


def test_tier_volume_summary(tables):
    got = {r["tier"]: (r["views"], r["rows"]) for r in load_plan.tier_volume_summary(tables).collect()}
    assert got == {
        "5": (3, 10_064_072_150), "4": (12, 5_258_346_885), "3": (27, 831_272_603),
        "2": (33, 104_032_536), "1": (51, 5_599_171), "?": (23, None),
        "total": (126, 16_263_323_345),
    }
    pct = {r["tier"]: r["pct"] for r in load_plan.tier_volume_summary(tables).collect()}
    assert round(pct["5"], 1) == 61.9 and round(pct["4"], 1) == 32.3 and pct["?"] is None


def test_concentration(tables):
    top = {r["top"]: r for r in load_plan.volume_concentration(tables).collect()}
    assert len(top) == 126
    assert round(top[3]["cum_pct"]) == 62 and round(top[15]["cum_pct"]) == 94
    assert top[126]["cum_pct"] == 100.0 and top[1]["name"] == "MDTB"


def test_split_reproduces_the_three_extractors(tables, erp):
    assigned = load_plan.balanced_split(tables, 3)
    got = {r["name"]: r["worker"] for r in assigned.collect()}
    views = [s.view for s in erp]
    recorded = {1: views[:49], 2: views[49:99], 3: views[99:]}
    assert {w: {v for v in got if got[v] == w} for w in (1, 2, 3)} == {w: set(v) for w, v in recorded.items()}

    summary = load_plan.split_summary(assigned).collect()
    totals = {r["worker"]: (r["items"], r["rows"]) for r in summary if r["tier"] == "total"}
    assert totals == {1: (49, 7_092_911_449), 2: (50, 5_031_468_909), 3: (50, 4_138_942_987)}
    items = {(r["worker"], r["tier"]): r["items"] for r in summary}
    for tier, counts in {"5": (1, 1, 1), "4": (4, 4, 4), "3": (9, 9, 9), "2": (11, 11, 11),
                         "1": (17, 17, 17), "?": (7, 8, 8)}.items():
        assert tuple(items[w, tier] for w in (1, 2, 3)) == counts

    queue = load_plan.split_order(assigned).orderBy("worker", "queue_place").collect()
    for worker, names in recorded.items():
        order = [r["name"] for r in queue if r["worker"] == worker]
        assert order == names


def test_extractor_queues(spark, erp):
    queues = jobs.extractor_queues(spark, erp, 3)
    assert [s for w in (1, 2, 3) for s in queues[w]] == erp
    assert [len(queues[w]) for w in (1, 2, 3)] == [49, 50, 50]


def test_split_of_several_plans(spark, tables):
    both = tables.withColumn("plan", F.lit("a")).unionByName(
        tables.where("tier = '2'").withColumn("plan", F.lit("b")))
    got = load_plan.balanced_split(both, 2, "plan").groupBy("plan", "worker").count().collect()
    assert {(r["plan"], r["worker"]): r["count"] for r in got if r["plan"] == "b"} == {("b", 1): 17, ("b", 2): 16}
    assert sum(r["count"] for r in got if r["plan"] == "a") == 149


def test_orders_of_tiers(spark):
    tiers = spark.createDataFrame([(t,) for t in "5?421-3"], "tier string")

    def order(by):
        return [r[0] for r in tiers.orderBy(classify.tier_rank(F.col("tier"), by)).collect()]

    assert order(classify.REPORT_ORDER) == list("12?345-")
    assert order(classify.LOAD_ORDER) == list("1?2345-")


def test_catalog_filter_and_single_table(spark):
    entries = spark.createDataFrame(
        [("erp", "A", "tb_A", "1"), ("erp", "B", "tb_B", "4"), ("ledger", "C", "tb_C", "-")],
        "domain string, view string, table string, tier string")
    kept = load_plan.catalog_filter(entries, ["erp", "ledger"], ["1"], ["erp"])
    assert {r["view"] for r in kept.collect()} == {"A", "C"}
    assert load_plan.single_table_filter(entries, "tb_B").first()[:] == ("erp", "B", "tb_B", "4")
    assert load_plan.single_table_filter(entries, "tb_X").first()[:] == ("custom", "tb_X", "tb_X", "-")


def test_merge_and_compare_catalogues(spark):
    schema = "table string, key_columns string"
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], schema)
    new = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1"), ("d", "1")], schema)
    merged = load_plan.merge_catalogues(old, new)
    assert sorted(map(tuple, merged.collect())) == [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")]
    changes = load_plan.compare_catalogues(old, new.distinct()).select("table", "change")
    assert dict(map(tuple, changes.collect())) == {"a": "dropped", "b": "rekeyed", "c": "kept", "d": "added"}


def test_previous_extract_of_every_source(spark):
    """All 194 earlier queries: key, load and sample by tier."""
    as_of = datetime(2026, 7, 30)
    stamps = ["2026-07-01 00:00:00"] * 12 + ["2024-07-01 00:00:00", "garbage", None]
    for s in catalogue.catalogue():
        columns = ", ".join(f"'{c.lower()}' as `{c}`" for c in s.key_columns)
        df = spark.createDataFrame([(t,) for t in stamps], "DATETIMESTAMP string").selectExpr(
            *columns.split(", "), "DATETIMESTAMP")
        out = jobs.previous_extract(s, df, as_of, SAMPLE_ROWS if s.sampled else None)
        assert out.columns[0] == f"{s.view}_PK"
        if s.view in ("MDMA", "EQUI", "MDTB", "F4111", "COSP"):
            want = {"full": 15, "text": 13, "timestamp": 10 if s.sampled else 12}[s.load]
            rows = out.collect()
            assert len(rows) == want, s
            assert rows[0][0] == "_".join(c.lower() for c in s.key_columns)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_over_ranges(spark, parts):
    """Against a plain loop, with nulls, ties that the last column tells apart, and no rows."""
    configure(spark)
    rng = random.Random(parts)
    lines = [(rng.choice([None, 0, 1, 5, 5, 10**12]), f"t{i:04}", i) for i in range(700)]
    df = spark.createDataFrame(lines, "n long, name string, x int").repartition(parts)
    found = ranges.running(df, [F.desc("n"), F.asc("name")], ["n", "x"])
    want, n, x = [], 0, 0
    for i, r in enumerate(sorted(lines, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])), 1):
        n, x = n + (r[0] or 0), x + r[2]
        want.append((*r, i, n, x))
    got = [(r.n, r.name, r.x, r.place, r.n_so_far, r.x_so_far) for r in found.orderBy("place").collect()]
    assert got == want
    assert {(r.n_total, r.x_total) for r in found.collect()} == {(n, x)}
    assert ranges.running(df.limit(0), [F.col("n")], ["n"]).count() == 0
    with pytest.raises(ValueError, match="n_so_far"):
        ranges.running(df.withColumn("N_so_far", F.lit(1)), [F.col("n")], ["n"])


def test_places_of_a_plan_need_no_single_task(spark):
    configure(spark)
    tables = spark.range(3000, numPartitions=4).selectExpr("concat('t', id) name", "if(id % 7 = 0, null, id % 50) n", "'1' tier")
    for found in (load_plan.volume_concentration(tables), load_plan.small_first_order(tables)):
        text = found._jdf.queryExecution().toString()
        assert "SinglePartition" not in text and "Window" in text
    assert [r.queue_place for r in load_plan.small_first_order(tables).orderBy("queue_place").collect()] == list(range(1, 3001))
    assert load_plan.volume_concentration(tables).agg(F.max("cum_pct")).first()[0] == 100
