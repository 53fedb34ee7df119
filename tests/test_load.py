"""Incremental loads into keyed tables."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import extract, load, sink, state
from tidemark.plans import jobs
from tidemark.sources import catalogue

START = "2026-08-01 00:00:00"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def source(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, v string, DATETIMESTAMP string")


DAY1 = [(1, "a", "2026-08-01 00:00:00"), (2, "b", "2026-08-01 10:00:00.500000"), (3, "c", "2026-07-31 23:59:59")]
DAY2 = DAY1 + [(4, "d", "2026-08-02 00:00:00"), (2, "b2", "2026-08-02 09:00:00"), (5, "late", "2026-08-01 05:00:00")]


def run(spark, root, rows, load_id, **kw):
    return load.run_load(spark, source(spark, *rows), "q", f"{root}/t", f"{root}/s", load_id, START, **kw)


def stored(spark, root):
    return sorted(r["id"] for r in sink.read_table(spark, f"{root}/t").collect())


@pytest.mark.parametrize("text,kept", [
    ("2026-08-01 00:00:00", True), ("2026-08-01 00:00:00.000000", True), ("2026-07-31 23:59:59.999999", False),
    ("garbage", True), ("2026-08-01T00:00:00", True), ("2026-08-01", False), ("", False), (None, False),
])
def test_filter_compares_text(spark, text, kept):
    assert extract.incremental_filter(source(spark, (1, "a", text)), START).count() == kept


@pytest.mark.parametrize("text,kept", [
    ("2026-08-01 00:00:00", True), ("2026-08-01 00:00:00.000000", True), ("2026-07-31 23:59:59.999999", False),
    ("garbage", False), ("2026-08-01T00:00:00", False), ("2026-08-01", False), (None, False),
])
def test_window_compares_instants(spark, text, kept):
    from datetime import datetime
    df = extract.window_by_timestamp(source(spark, (1, "a", text)), datetime(2027, 8, 1))
    assert df.count() == kept


def test_window_start_of_leap_day():
    from datetime import datetime
    assert extract.window_start(datetime(2024, 2, 29, 1)) == datetime(2023, 2, 28, 1)


def test_catch_up_then_delta(spark, root):
    assert run(spark, root, DAY1, 0) == 2
    assert state.read_mark(spark, f"{root}/s", "q") == "2026-08-01 10:00:00.500000"
    # the boundary row is read again, the late row is not
    assert run(spark, root, DAY2, 1) == 3
    assert stored(spark, root) == [1, 2, 2, 4]
    late = state.late_rows(source(spark, *DAY2), "2026-08-01 10:00:00.500000")
    assert sorted(r["id"] for r in late.collect()) == [1, 3, 5]


def test_replay_changes_nothing(spark, root):
    run(spark, root, DAY1, 0)
    run(spark, root, DAY2, 1)
    before = sorted(map(tuple, sink.read_table(spark, f"{root}/t").collect()))
    run(spark, root, DAY2, 1)  # as after a failure between sink and commit
    assert sorted(map(tuple, sink.read_table(spark, f"{root}/t").collect())) == before
    run(spark, root, DAY2, 2)
    assert len(before) == len(stored(spark, root))


def test_repeated_first_load_starts_where_it_started(spark, root):
    run(spark, root, DAY1, 0)
    assert run(spark, root, DAY1, 0) == 2


def test_state_stays_two_rows_per_query(spark, root):
    days = [f"2026-08-0{i} 00:00:00" for i in range(1, 8)]
    for n, load_id in enumerate([0, 2, 4, 5, 9, 9, 10]):
        for q, day in (("q", days[n]), ("r", days[0])):
            state.write_mark(spark, root, q, day, load_id, state.last_mark(spark, root, q, load_id))
        assert state.read_mark(spark, root, "q") == days[n]
        before = [days[k] for k, i in enumerate([0, 2, 4, 5, 9, 9, 10]) if i < load_id]
        assert state.read_mark(spark, root, "q", START, before_load=load_id) == (before or [START])[-1]
    assert spark.read.parquet(root).count() == 4
    assert {r["query"]: r["high_water"] for r in state.read_marks(spark, root).collect()} == {"q": days[6], "r": days[0]}
    assert state.read_mark(spark, root, "new", START) == START


def test_garbage_does_not_become_the_mark(spark, root):
    run(spark, root, [*DAY1, (9, "x", "garbage")], 0)
    assert state.read_mark(spark, f"{root}/s", "q") == "2026-08-01 10:00:00.500000"
    assert run(spark, root, DAY2, 1) == 3
    literal = source(spark, (9, "x", "garbage")).agg(state.mark_value(well_formed_only=False)).first()[0]
    assert literal == "garbage"


def test_empty_load_keeps_the_mark(spark, root):
    assert run(spark, root, [(1, "a", "2020-01-01 00:00:00")], 0) == 0
    assert state.read_mark(spark, f"{root}/s", "q") == START
    assert run(spark, root, DAY1, 1) == 2


def test_source_gains_a_column(spark, root):
    run(spark, root, DAY1, 0)
    wider = source(spark, *DAY2).withColumn("w", F.lit(7))
    load.run_load(spark, wider, "q", f"{root}/t", f"{root}/s", 1, START)
    rows = sink.read_table(spark, f"{root}/t").collect()
    assert {r["w"] for r in rows} == {None, 7}


def test_a_column_changes_its_type(spark, root):
    """Columns kept as one VARIANT take any type; keys are those of the typed rows."""
    def go(df, load_id):
        return load.run_load(spark, df, "q", f"{root}/t", f"{root}/s", load_id, START, updated_ms=load_id, as_variant=True)

    first, second = source(spark, *DAY1), source(spark, *DAY2).withColumn("id", F.concat(F.lit("x"), "id"))
    assert go(first, 0) == 2
    assert state.read_mark(spark, f"{root}/s", "q") == "2026-08-01 10:00:00.500000"
    assert go(second, 1) == 3
    table = sink.read_table(spark, f"{root}/t")
    assert table.columns[:2] == ["key", "columns"]
    ids = table.select(F.try_variant_get("columns", "$.id", "string")).collect()
    assert sorted(r[0] for r in ids) == ["1", "2", "x2", "x2", "x4"]
    want = {r[0] for d in (first.where("id < 3"), second.where(F.col("DATETIMESTAMP") >= "2026-08-01 10"))
            for r in d.select(keys.row_key(d)).collect()}
    assert {r["key"] for r in table.collect()} == want


def test_last_write_wins_and_time_moves(spark, root):
    df = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, v string")
    sink.write_load(df, f"{root}/t", 0, 1000)
    sink.write_load(df.where("key = 'k2'").withColumn("v", F.lit("c")), f"{root}/t", 1, 2000)
    rows = {r["key"]: (r["v"], r["last_updated_time"]) for r in sink.read_table(spark, f"{root}/t").collect()}
    assert rows == {"k1": ("a", 1000), "k2": ("c", 2000)}
    recent = sink.read_table(spark, f"{root}/t", since_load=1).collect()
    assert [r["key"] for r in recent] == ["k2"]
    sink.compact(spark, f"{root}/t")
    sink.write_load(df.where("key = 'k1'").withColumn("v", F.lit("z")), f"{root}/t", 2, 3000)
    rows = {r["key"]: r["v"] for r in sink.read_table(spark, f"{root}/t").collect()}
    assert rows == {"k1": "z", "k2": "c"}


def test_compaction_then_replay_of_any_load(spark, root):
    """A load repeated after a compaction, with more rows than before, loses nothing."""
    def table():
        rows = sink.read_table(spark, f"{root}/t").collect()
        return {r["key"]: (r["v"], r["load_id"]) for r in rows}

    df = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, v string")
    sink.write_load(df, f"{root}/t", 0)
    sink.write_load(df.where("key = 'b'").withColumn("v", F.lit("2")), f"{root}/t", 1)
    want = {"a": ("1", 0), "b": ("2", 1)}
    for _ in range(2):
        sink.compact(spark, f"{root}/t")
        assert table() == want
        assert sink.read_loads(spark, f"{root}/t").count() == len(want)
        for load_id, v in ((0, "1"), (1, "2")):
            rows = df if load_id == 0 else df.where("key = 'b'").withColumn("v", F.lit("2"))
            sink.write_load(rows.union(spark.createDataFrame([("c", v)], df.schema)), f"{root}/t", load_id)
        want = {"a": ("1", 0), "b": ("2", 1), "c": ("2", 1)}
        assert table() == want
    assert {r["key"] for r in sink.read_table(spark, f"{root}/t", since_load=1).collect()} == {"b", "c"}


def versions(spark, root):
    return {r["key"]: (r["v"], r["load_id"]) for r in sink.read_table(spark, f"{root}/t").collect()}


def store(spark, root, load_id, v, *keys):
    df = spark.createDataFrame([(k, v) for k in keys], "key string, v string")
    sink.write_load(df, f"{root}/t", load_id)


@pytest.mark.parametrize("rows", [("a",), ("c",), ()])
def test_a_repeated_load_replaces_its_folded_rows(spark, root, rows):
    """As without the compaction: rows it no longer has go, those of earlier loads that it had replaced are back."""
    for load_id, v, names in ((0, "0", "ab"), (1, "1", "bd"), (2, "2", "d")):
        store(spark, root, load_id, v, *names)
    sink.compact(spark, f"{root}/t")
    assert versions(spark, root) == {"a": ("0", 0), "b": ("1", 1), "d": ("2", 2)}
    store(spark, root, 1, "1b", *rows)
    want = {"a": ("0", 0), "b": ("0", 0), "d": ("2", 2)} | {k: ("1b", 1) for k in rows}
    assert versions(spark, root) == want
    store(spark, root, 2, "2b")
    store(spark, root, 0, "0b", "a", "d")
    want = {"a": ("0b", 0), "d": ("0b", 0)} | {k: ("1b", 1) for k in rows}
    assert versions(spark, root) == want
    sink.compact(spark, f"{root}/t")
    assert versions(spark, root) == want
    assert sink.read_loads(spark, f"{root}/t").count() == len(want)


def test_vacuum_settles_loads(spark, root):
    folders = lambda: sorted(p.name for p in Path(f"{root}/t").iterdir() if p.name.startswith("load_id="))
    with pytest.raises(ValueError, match="no base"):
        sink.vacuum(spark, f"{root}/t")
    for load_id, v, names in ((0, "0", "ab"), (1, "1", "bc"), (2, "2", "c")):
        store(spark, root, load_id, v, *names)
    sink.compact(spark, f"{root}/t")
    store(spark, root, 1, "1", "b", "c")
    with pytest.raises(ValueError, match="compact first"):
        sink.vacuum(spark, f"{root}/t")
    sink.compact(spark, f"{root}/t", before_load=2)
    assert sink.vacuum(spark, f"{root}/t") == 2 and folders() == ["load_id=2"]
    assert sink.vacuum(spark, f"{root}/t") == 0
    want = {"a": ("0", 0), "b": ("1", 1), "c": ("2", 2)}
    assert versions(spark, root) == want
    with pytest.raises(ValueError, match="settled"):
        store(spark, root, 1, "x", "a")
    with pytest.raises(ValueError, match="settled"):
        sink.compact(spark, f"{root}/t", before_load=1)
    sink.compact(spark, f"{root}/t")  # load 2 replaces c, whose earlier row is in the settled base alone
    assert versions(spark, root) == want
    store(spark, root, 2, "2b", "d")
    assert versions(spark, root) == {"a": ("0", 0), "b": ("1", 1), "c": ("1", 1), "d": ("2b", 2)}
    sink.compact(spark, f"{root}/t")
    assert sink.vacuum(spark, f"{root}/t") == 1 and folders() == []
    assert versions(spark, root) == {"a": ("0", 0), "b": ("1", 1), "c": ("1", 1), "d": ("2b", 2)}
    assert len(list(Path(f"{root}/t/_base").iterdir())) == 1
    store(spark, root, 3, "3", "a")
    assert versions(spark, root)["a"] == ("3", 3) and len(versions(spark, root)) == 4


LOADS = st.lists(st.tuples(st.integers(0, 3), st.sets(st.sampled_from("abcd")), st.sampled_from(["", "", "fold", "part"])),
                 min_size=1, max_size=7)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(LOADS)
def test_loads_and_compactions_in_any_order(spark, tmp_path_factory, loads):
    root, want = str(tmp_path_factory.mktemp("any")), {}
    for n, (load_id, names, then) in enumerate(loads):
        store(spark, root, load_id, str(n), *names)
        want[load_id] = {k: (str(n), load_id) for k in names}
        if then:
            sink.compact(spark, f"{root}/t", before_load=None if then == "fold" else load_id + 1)
        table = {}
        for i in sorted(want):
            table |= want[i]
        assert versions(spark, root) == table


def test_compaction_that_dies_changes_nothing(spark, root):
    df = spark.createDataFrame([("a", "1")], "key string, v string")
    sink.write_load(df, f"{root}/t", 0)
    df.withColumn("load_id", F.lit(0)).write.parquet(f"{root}/t/_base/1")  # without its list of files
    sink.write_load(df.withColumn("key", F.lit("b")), f"{root}/t", 1)
    assert sink.read_table(spark, f"{root}/t").count() == 2
    sink.compact(spark, f"{root}/t")
    assert sink.read_table(spark, f"{root}/t").count() == 2
    with pytest.raises(ValueError):
        sink.compact(spark, f"{root}/nothing")


def test_columns_are_noted_beside_the_table(spark, root):
    one = spark.createDataFrame([("a", 1)], "key string, v int")
    sink.write_load(one, f"{root}/t", 0)
    sink.write_load(one.withColumn("w", F.lit("x")), f"{root}/t", 1)
    assert sink.table_schema(spark, f"{root}/t").names == ["key", "v", "w"]
    assert sink.read_table(spark, f"{root}/t").columns == ["key", "v", "w", "load_id"]
    sink.write_load(one.withColumn("v", F.lit("text")), f"{root}/t", 2)
    with pytest.raises(ValueError, match="column 'v'"):
        sink.read_table(spark, f"{root}/t")


@pytest.mark.parametrize("as_variant", [False, True])
def test_rows_without_a_time_are_stored_once(spark, root, as_variant):
    rows = [*DAY1, (9, "x", "garbage"), (10, "y", "zzz")]
    assert run(spark, root, rows, 0, as_variant=as_variant) == 4
    assert [run(spark, root, rows, i, as_variant=as_variant) for i in (1, 2, 2)] == [1, 1, 1]
    assert run(spark, root, [*rows, (11, "z", "garbage")], 3, as_variant=as_variant) == 2
    assert run(spark, root, [*rows, (11, "z", "garbage")], 3, as_variant=as_variant) == 2  # repeated
    assert sink.read_table(spark, f"{root}/t").count() == 5


ROWS = st.lists(st.tuples(
    st.sampled_from("abc") | st.none(), st.integers(0, 3), st.integers(0, 2) | st.none()), max_size=30)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, ROWS)
def test_upsert_against_a_dictionary(spark, first, second):
    """Last write per key, ties by value; applying a batch twice, or both at once, is the same."""
    schema = "key string, seq int, v int"
    old, new = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    want = {}
    for key, seq, v in sorted(first + second, key=lambda r: (r[1], -1 if r[2] is None else r[2])):
        if key is not None:
            want[key] = (seq, v)

    def rows(df):
        return {r["key"]: (r["seq"], r["v"]) for r in df.collect()}

    empty = old.limit(0)
    stored = sink.upsert(sink.upsert(empty, old, "key", ["seq"]), new, "key", ["seq"])
    assert rows(stored) == rows(sink.upsert(stored, new, "key", ["seq"])) == want
    assert rows(sink.upsert(empty, old.unionByName(new), "key", ["seq"])) == want


def test_null_keys_are_set_aside(spark):
    df = spark.createDataFrame([("k", 1), (None, 2), (None, 3)], "key string, v int")
    assert sink.upsert(df.limit(0), df, "key", ["v"]).count() == 1
    assert sink.null_keys(df).count() == 2
    dups = {tuple(r) for r in sink.duplicate_keys(df, "key").collect()}
    assert dups == {(None, 2)}
    stats = sink.upsert_stats(df, "key").first()
    assert stats[:] == (3, 1, 2)


def test_rows_with_values_that_have_no_order(spark):
    df = spark.sql("""select 'k' key, 1 seq, parse_json('{"a":1}') v, map('a', 1) m
        union all select 'k', 2, parse_json('{"a":2}'), map('a', 2)""")
    row = sink.last_per_key(df, "key", ["seq"]).first()
    assert row["seq"] == 2 and row["m"] == {"a": 2}


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    """A third of the rows share a key: each task sends one of them."""
    df = spark.range(0, 90_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    latest = sink.last_per_key(df, "key", ["id"])
    assert latest.where("key = 'hot'").first()["id"] == 89_997
    assert latest.count() == 60_001
    plan = latest._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "partial_max" in plan[exchange:]


def test_advance(spark):
    marks = spark.createDataFrame([("a", "2026-09-01 00:00:00"), ("b", None)], "query string, high_water string")
    batch = spark.createDataFrame(
        [("a", "2026-08-15 00:00:00"), ("b", "2026-08-02 00:00:00"), ("c", "garbage"), ("c", None)],
        "query string, DATETIMESTAMP string")
    got = dict(map(tuple, state.advance(marks, batch, initial_start=START).collect()))
    assert got == {"a": "2026-09-01 00:00:00", "b": "2026-08-02 00:00:00", "c": START}


def test_run_goes_on_after_a_failure(spark, root):
    picked = [s for s in catalogue.sources("ledger_in") if s.view in ("F0010", "F4108", "F42119")]

    def read(s):
        if s.view == "F4108":
            return spark.table("no_such_view")
        df = source(spark, *DAY1)
        return df.drop("DATETIMESTAMP") if s.view == "F42119" else df

    ledger = jobs.load_sources(spark, picked, read, f"{root}/raw", f"{root}/state", 0, START)
    rows = {r["query"]: (r["status"], r["rows"], r["error_class"]) for r in ledger.collect()}
    assert rows == {
        "extract-ledger_in-F0010": ("success", 2, None),
        "extract-ledger_in-F4108": ("failure", None, "missing_object"),
        "extract-ledger_in-F42119": ("failure", None, "unresolved_column"),
    }
    result = load.run_result(ledger).first()
    assert result["failed"] == "extract-ledger_in-F4108, extract-ledger_in-F42119"
    assert result["status"] == "failure" and result["rows"] == 2


def test_loads_at_the_same_time(spark, root):
    def one(i):
        return f"q{i}", lambda: load.run_load(
            spark, source(spark, *DAY1), f"q{i}", f"{root}/t{i}", f"{root}/s", 0, START)

    ledger = load.run_all(spark, [one(i) for i in range(6)] + [("bad", lambda: 1 / 0)], parallel=3)
    rows = [(r["query"], r["status"], r["rows"]) for r in ledger.collect()]
    assert rows == [(f"q{i}", "success", 2) for i in range(6)] + [("bad", "failure", None)]


def test_key_in_sink_is_the_row_key(spark, root):
    run(spark, root, DAY1, 0)
    df = source(spark, *DAY1)
    want = {r[0] for r in df.where("id < 3").select(keys.row_key(df)).collect()}
    assert {r["key"] for r in sink.read_table(spark, f"{root}/t").collect()} == want


def test_work_dir_follows_the_cluster_setting(spark):
    from tidemark.session import SHARED, work_dir

    def session(setting=None, context=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: setting if key == SHARED else default),
            sparkContext=SimpleNamespace(getCheckpointDir=lambda: context))

    assert work_dir(session("hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert work_dir(session(context="/own"), "x").startswith("/own/x-")
    with pytest.raises(ValueError):
        work_dir(session(), "x")
    assert "/x-" in work_dir(spark, "x")
