"""One query per operator over the test tables; `oracle.py` states the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import classify, keys, times
from tidemark.operators import extract, history, inspect, load, reconcile, sink, state, stats
from tidemark.plans import jobs, load_plan
from tidemark.session import configure, work_dir
from tidemark.sources import views
from tidemark.sources.views import START, TABLES, TIERED, TODAY, YESTERDAY, table
from tidemark.streaming import continuous

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SINCE = times.day_start_ms(datetime.fromisoformat(TODAY))
SINCE_YESTERDAY = times.day_start_ms(datetime.fromisoformat(YESTERDAY))
ORDERS_AS_OF = datetime(2001, 1, 1)
UPDATED_MS = 1_706_000_000_000


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _alike(df: DataFrame, *counts: str) -> DataFrame:
    """Times as text and counts that can be null as doubles: read alike from both engines."""
    times_as_text = {
        f.name: F.date_format(f.name, views.MICROS)
        for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"
    }
    return df.withColumns(times_as_text | {c: F.col(c).cast("double") for c in counts})


# --- sources and sinks ---


@query
def scan_view(spark, sf):
    return _alike(views.src_events(spark, sf))


@query
def raw_upsert(spark, sf):
    """Line items stored once, then those of the last years stored again with another quantity."""
    first = views.business_lines(spark, sf).withColumn("load_id", F.lit(0))
    again = (
        first.where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
        .withColumns({"l_quantity": F.col("l_quantity") + 1, "load_id": F.lit(1)})
    )
    return _alike(sink.upsert(first, again, "key", ["load_id"]))


@query
def raw_upsert_stats(spark, sf):
    return sink.upsert_stats(views.business_lines(spark, sf), "key", by=["l_returnflag"])


@query
def state_advance(spark, sf):
    """Marks after 9 January (none for signups), advanced by the rows at or after them."""
    events = views.src_events(spark, sf).withColumnRenamed("event_type", "query")
    before = events.where((F.col("DATETIMESTAMP") < "2024-01-10") & (F.col("query") != "signup"))
    marks = before.groupBy("query").agg(state.mark_value().alias("high_water"))
    batch = events.where(F.col("DATETIMESTAMP") >= "2024-01-10")
    guarded = state.advance(marks, batch, initial_start=START)
    literal = state.advance(marks, batch, initial_start=START, well_formed_only=False)
    return guarded.join(literal.withColumnRenamed("high_water", "high_water_literal"), "query")


def _stats(spark, sf, since=SINCE, today=TODAY) -> DataFrame:
    rows = views.with_source_day(views.raw_rows_dup(spark, sf))
    return stats.table_stats(
        views.catalog(spark, sf), rows, since, today, failures=views.failures(spark)
    )


def _history_entry(spark, sf, seq, since, today) -> DataFrame:
    s = _stats(spark, sf, since, today)
    return history.history_entry(s, TIERED, seq, today, f"{today}T23:00:00Z")


@query
def history_append(spark, sf):
    path = work_dir(spark, "history")
    history.append_history(_history_entry(spark, sf, 1, SINCE_YESTERDAY, YESTERDAY), path)
    history.append_history(_history_entry(spark, sf, 2, SINCE, TODAY), path)
    lines = history.read_history(spark, path)
    return lines.select("seq", "day", F.explode("summary.by_domain").alias("domain", "c")).select(
        "seq", "day", "domain", "c.tables", "c.upd_today", "c.src_today", "c.src_old"
    )


def _ingest_history(spark, sf) -> DataFrame:
    """A line per day; then a blank, a repeated 18 January, a cut line and today again."""
    rows = views.raw_rows(spark, sf)
    day = F.expr("date_format(timestamp_millis(last_updated_time), 'yyyy-MM-dd')")
    counts = rows.groupBy(day.alias("day"), "domain").agg(F.count("*").alias("upd_today"))
    per_day = counts.groupBy("day").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("domain", F.struct("upd_today"))))
        ).alias("by_domain")
    )
    line = F.to_json(F.struct("day", F.struct("by_domain").alias("summary")))
    lines = per_day.select("day", line.alias("line"), F.datediff(F.col("day"), F.lit("2024-01-01")).alias("d"))
    seq = F.col("d").cast("long")
    parts = [
        lines.select(seq.alias("seq"), "line"),
        lines.where(F.col("day") == "2024-01-10").select((seq + 1000).alias("seq"), F.lit("  ").alias("line")),
        lines.where(F.col("day") == "2024-01-18").select((seq + 2000).alias("seq"), "line"),
        lines.where(F.col("day") == "2024-01-19").select(
            (seq + 3000).alias("seq"), F.col("line").substr(1, 20).alias("line")),
        lines.where(F.col("day") == TODAY).select((seq + 4000).alias("seq"), "line"),
    ]
    return _union(parts)


@query
def history_previous(spark, sf):
    lines = history.parse_history(_ingest_history(spark, sf))
    previous = history.history_previous(lines, TODAY)
    return previous.select("seq", "day", F.explode("summary.by_domain").alias("domain", "c")).select(
        "seq", "day", "domain", "c.upd_today"
    )


# --- keys and scalar expressions ---


@query
def canonical_json(spark, sf):
    df = views.src_events(spark, sf)
    return df.select("event_id", keys.canonical_json(df).alias("row_json"))


@query
def json_escape(spark, sf):
    texts = _union([
        table(spark, sf, name).select(F.lit(name).alias("kind"), F.col(i).alias("id"), F.col(text).alias("t"))
        for name, i, text in (("pages", "page_id", "html"), ("documents", "doc_id", "text"))
    ])
    escaped = keys.json_escape(F.col("t"))
    unicode = keys.json_escape(F.col("t"), separators="unicode")
    return texts.select(
        "kind", "id", F.length(escaped).cast("long").alias("n_chars"), F.sha2(escaped, 256).alias("digest"),
        F.sha2(unicode, 256).alias("digest_unicode"),
    )


@query
def row_key_sha256(spark, sf):
    df = views.src_events(spark, sf)
    return df.select(keys.row_key(df).alias("key"), "event_id")


@query
def row_key_tables(spark, sf):
    """The whole-row key of every row of every table."""
    frames = []
    for name in TABLES:
        df = table(spark, sf, name)
        frames.append(df.select(F.lit(name).alias("table"), keys.row_key(df).alias("key")))
    return _union(frames)


@query
def key_change_append(spark, sf):
    """Keys that appear when the total of the pending orders changes."""
    orders = table(spark, sf, "orders")
    total = F.col("o_totalprice")
    changed = orders.withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") == "P", total + 1).otherwise(total)
    )
    old = orders.select(keys.row_key(orders).alias("key"))
    new = changed.select(keys.row_key(changed).alias("key"), "o_orderkey")
    return new.join(old, "key", "left_anti")


@query
def business_key(spark, sf):
    df = views.src_events(spark, sf)
    return df.select(keys.business_key("event_type", "user_id", "DATETIMESTAMP").alias("pk"), "event_id")


@query
def single_column_key(spark, sf):
    df = table(spark, sf, "orders")
    return keys.with_key(df, keys.single_column_key("o_orderkey"), "T_PK").drop("o_orderdate")


@query
def business_key_dups(spark, sf):
    day = F.col("DATETIMESTAMP").substr(1, 10)
    df = views.src_events(spark, sf)
    keyed = df.select(keys.business_key("event_type", "user_id", day).alias("key"))
    return sink.duplicate_keys(keyed, "key")


@query
def derive_names(spark, sf):
    ids = table(spark, sf, "part").select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("id")).distinct()
    names = keys.derived_names(F.col("id"), "erp", "hub.stage.v_", "Erp")
    return ids.select("id", *[c.alias(n) for n, c in names.items()])


@query
def parse_ts(spark, sf):
    rows = views.raw_rows(spark, sf)
    parsed = times.parse_ts(F.col("ts_text"))
    return rows.select("key", F.date_format(parsed, views.MICROS).alias("parsed"))


@query
def parse_source_day(spark, sf):
    return views.with_source_day(views.raw_rows(spark, sf)).select("key", "source_day")


@query
def column_fallback(spark, sf):
    value = times.field_with_fallback(F.col("columns"), "DATETIMESTAMP")
    return views.raw_columns(spark, sf).select(
        "event_id",
        F.try_variant_get(value, "$", "string").alias("value"),
        times.source_day_of_variant(value).alias("source_day"),
    )


# --- filters, projections, samples ---


@query
def incremental_filter(spark, sf):
    return extract.incremental_filter(views.src_events(spark, sf), START).select(
        "event_id", "event_type", "DATETIMESTAMP"
    )


def _order_columns(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_custkey", "DATETIMESTAMP")


@query
def window_1y_timestamp(spark, sf):
    return _order_columns(extract.window_by_timestamp(views.src_orders(spark, sf), ORDERS_AS_OF))


@query
def window_1y_string(spark, sf):
    return _order_columns(extract.window_by_text(views.src_orders(spark, sf), ORDERS_AS_OF))


@query
def full_load(spark, sf):
    df = extract.windowed_extract(
        views.src_orders(spark, sf), ["o_custkey", "o_orderkey"], "PK", "full", ORDERS_AS_OF
    )
    return df.drop("o_orderdate")


@query
def smoke_sample(spark, sf):
    keyed = keys.with_key(views.src_events(spark, sf)).select("key", "event_id", "event_type")
    return extract.smoke_sample(keyed, ["key"])


@query
def key_projection(spark, sf):
    return _alike(keys.with_key(views.src_events(spark, sf)))


@query
def updated_since(spark, sf):
    return stats.updated_since(views.raw_rows(spark, sf), SINCE).select(
        "table", "key", "last_updated_time"
    )


@query
def updated_since_zone(spark, sf):
    """The day starts at midnight of a named zone, three hours after that of UTC."""
    since = times.day_start_ms(datetime.fromisoformat(f"{TODAY}T12:00:00"), "America/Sao_Paulo")
    return stats.updated_since(views.raw_rows(spark, sf), since).select("table", "key", "last_updated_time")


@query
def catalog_filter(spark, sf):
    return load_plan.catalog_filter(
        views.catalog(spark, sf), ["erp", "ledger_in"], ["1", "2", "?"], TIERED
    )


@query
def single_table_filter(spark, sf):
    entries = views.catalog(spark, sf)
    return _union([load_plan.single_table_filter(entries, t) for t in ("tb_error", "tb_nowhere")])


# --- aggregations ---


@query
def count_view(spark, sf):
    return reconcile.count_view(table(spark, sf, "lineitem"))


def _counts(spark, sf) -> DataFrame:
    targets = [(name, f"{sf}/{name}.parquet", ()) for name in TABLES]
    targets += [
        ("no_such_file", f"{sf}/no_such_file.parquet", ()),
        ("no_such_column", f"{sf}/orders.parquet", ("no_such_column",)),
        ("damaged", _damaged(spark, f"{work_dir(spark, 'counts')}/damaged", table(spark, sf, "orders")), ()),
    ]
    return reconcile.count_many(spark, targets)


def _damaged(spark, path: str, rows: DataFrame) -> str:
    """A stored table of which one file is no parquet file."""
    sink.write_load(rows, path, 0)
    spark.range(1).select(F.lit("damaged").alias("value")).write.text(f"{path}/{sink.LOAD}=1")
    return path


@query
def count_many(spark, sf):
    counts = _counts(spark, sf)
    status = F.when(F.col("status") == "OK", "OK").otherwise(classify.error_class(F.col("status")))
    return _alike(counts.select("label", "n", status.alias("status")), "n")


@query
def count_many_total(spark, sf):
    return reconcile.count_many_total(_counts(spark, sf))


def _expected_vs_rows(spark, sf) -> DataFrame:
    rows = views.raw_rows(spark, sf).select("table")
    return reconcile.union_counts(views.expected_counts(spark, sf), rows)


@query
def union_counts(spark, sf):
    return _expected_vs_rows(spark, sf)


def _fresh(spark, sf) -> DataFrame:
    rows = stats.updated_since(views.raw_rows_dup(spark, sf), SINCE)
    return views.with_source_day(rows)


@query
def rows_updated(spark, sf):
    return stats.rows_updated(_fresh(spark, sf))


@query
def unique_keys(spark, sf):
    return stats.unique_keys(_fresh(spark, sf))


@query
def source_age_split(spark, sf):
    return stats.source_age_split(stats.day_counts(_fresh(spark, sf)), TODAY).drop("rows_today")


@query
def top_source_days(spark, sf):
    return stats.top_source_days(stats.day_counts(_fresh(spark, sf)))


@query
def table_stats(spark, sf):
    top = F.array_join(
        F.transform("top_source_days", lambda t: F.concat(t["day"], F.lit("="), t["n"].cast("string"))),
        ", ",
    )
    return _stats(spark, sf).withColumn("top_source_days", top)


@query
def summary_by_domain(spark, sf):
    return stats.summary_by_domain(_stats(spark, sf))


@query
def summary_by_tier(spark, sf):
    return stats.summary_by_tier(_stats(spark, sf), TIERED)


@query
def run_totals(spark, sf):
    return stats.run_totals(_stats(spark, sf))


def _volumes(spark, sf) -> DataFrame:
    return load_plan.with_tier(views.volumes(spark, sf), bounds=views.VOLUME_BOUNDS)


@query
def tier_volume_summary(spark, sf):
    return _alike(load_plan.tier_volume_summary(_volumes(spark, sf)), "rows")


@query
def volume_concentration(spark, sf):
    return load_plan.volume_concentration(_volumes(spark, sf))


# --- classification ---


@query
def reconcile_status(spark, sf):
    report = reconcile.reconcile_counts(_expected_vs_rows(spark, sf))
    return report.select("key", "status")


@query
def reconcile_counts(spark, sf):
    return reconcile.reconcile_counts(_expected_vs_rows(spark, sf))


@query
def ingest_flag(spark, sf):
    return _stats(spark, sf).where(F.col("status") == "OK").select("table", "flag")


@query
def table_status(spark, sf):
    return _stats(spark, sf).select("table", "status", "error")


@query
def tier_of_volume(spark, sf):
    return _alike(_volumes(spark, sf).select("name", "n", "tier"), "n")


@query
def report_row_class(spark, sf):
    return _stats(spark, sf).select(
        "table", classify.report_row_class(F.col("status"), F.col("flag")).alias("row_class")
    )


@query
def error_class(spark, sf):
    """Failure messages made from all events, in four shapes, by class."""
    i = F.col("event_id")
    message = (
        F.when(i % 4 == 0, F.concat(F.lit("('42P01', 'no view v_"), "user_id", F.lit("')\nat x")))
        .when(i % 4 == 1, F.concat(F.lit("('42703', 'no column C"), "user_id", F.lit("')")))
        .when(i % 4 == 2, F.lit("[UNRESOLVED_COLUMN.WITH_SUGGESTION] a column cannot be resolved\n42P"))
        .otherwise("read timed out")
    )
    errors = table(spark, sf, "events").select(message.alias("m"))
    first = classify.first_line(F.col("m"))
    return errors.groupBy(classify.error_class(first).alias("error_class")).agg(
        F.count("*").alias("n"), F.min(first).alias("example")
    )


# --- lookups, sorts, unions ---


@query
def day_over_day_delta(spark, sf):
    previous = history.history_previous(history.parse_history(_ingest_history(spark, sf)), TODAY)
    return history.day_over_day_delta(stats.summary_by_domain(_stats(spark, sf)), previous)


@query
def expected_vs_actual(spark, sf):
    return _expected_vs_rows(spark, sf).select(
        F.col("key").alias("table"), "expected_rows", F.col("row_ingested").alias("actual_rows")
    )


@query
def catalog_x_rows(spark, sf):
    entries = views.catalog(spark, sf)
    place = F.row_number().over(Window.partitionBy().orderBy("domain", "table"))
    counts = views.raw_rows(spark, sf).groupBy("table").agg(F.count("*").alias("n"))
    return _alike(load_plan.catalog_x_rows(entries.withColumn("place", place), counts), "stored_rows")


@query
def order_incremental(spark, sf):
    fresh = extract.incremental_filter(views.src_events(spark, sf), START)
    columns = fresh.select("DATETIMESTAMP", "event_id", "event_type")
    return extract.order_incremental(columns, "DATETIMESTAMP", "event_id")


@query
def order_reconcile(spark, sf):
    """The report with the place of each line: one line per table."""
    report = reconcile.reconcile_counts(_expected_vs_rows(spark, sf))
    order = Window.partitionBy().orderBy("status", F.desc("expected_rows"), "key")
    return reconcile.order_reconcile(report.withColumn("place", F.row_number().over(order)))


@query
def tier_sort(spark, sf):
    summary = load_plan.tier_volume_summary(_volumes(spark, sf))
    by_tier = summary.where(F.col("tier") != load_plan.TOTAL).select("tier", "views", "rows")
    rank = classify.tier_rank(F.col("tier"))
    return stats.tier_sort(_alike(by_tier.withColumn("rank", rank), "rows"))


@query
def small_first_order(spark, sf):
    queue = load_plan.small_first_order(_volumes(spark, sf))
    return _alike(queue.select("name", "tier", "n", "queue_place"), "n")


@query
def union_all(spark, sf):
    rows = views.raw_rows_dup(spark, sf).select("domain", "table", "key")
    return _union([rows.where(F.col("domain") == d) for d in ("erp", "ledger_in", "ledger_na")])


@query
def merge_dedupe(spark, sf):
    """The catalogue with one entry per document source merged in, and its own entries renamed."""
    existing = views.catalog(spark, sf)
    source = F.col("source")
    fresh = table(spark, sf, "documents").select(
        F.lit("erp").alias("domain"), F.upper(source).alias("view"),
        F.concat(F.lit("tb_"), source).alias("table"), F.lit("?").alias("tier"),
    )
    renamed = existing.withColumn("tier", F.lit("5"))
    return load_plan.merge_catalogues(existing, fresh.unionByName(renamed))


@query
def legacy_vs_live(spark, sf):
    """Tables named by brand and type in two generations of the part list, keyed by their parts."""
    part = table(spark, sf, "part")

    def generation(df):
        return df.groupBy(F.concat_ws("_", "p_brand", "p_type").alias("table")).agg(
            F.concat_ws(",", F.min("p_name"), F.max("p_name")).alias("key_columns")
        )

    return load_plan.compare_catalogues(
        generation(part.where("p_size <= 25")), generation(part.where("p_size >= 10"))
    )


# --- balanced split ---


def _split(spark, sf) -> DataFrame:
    return load_plan.balanced_split(_volumes(spark, sf), 3)


@query
def balanced_split(spark, sf):
    return _alike(_split(spark, sf).select("name", "tier", "n", "worker"), "n")


@query
def split_summary(spark, sf):
    return load_plan.split_summary(_split(spark, sf))


@query
def split_order(spark, sf):
    return load_plan.split_order(_split(spark, sf)).select("worker", "queue_place", "name", "tier")


# --- continuous operation ---


@query
def stream_incremental_upsert(spark, sf):
    """The events file as a stream, loaded into a keyed table by one run of the continuous load."""
    root = work_dir(spark, "stream")
    schema = table(spark, sf, "events").schema
    path = f"{sf}/{{events}}.parquet"  # a pattern, so that it may be one file or a folder
    stream = views.events_source(continuous.read_stream(spark, path, schema))
    run = continuous.start_load(
        stream, "events", f"{root}/table", f"{root}/state", f"{root}/checkpoint", START, once=True
    )
    run.awaitTermination()
    return sink.read_table(spark, f"{root}/table").select("key", "event_id", "DATETIMESTAMP")


@query
def catchup_then_delta(spark, sf):
    """A catch-up over what exists on 20 January, then the delta after it."""
    root = work_dir(spark, "catchup")
    events = views.src_events(spark, sf)
    early = events.where(F.col("ts") < F.lit(TODAY).cast("timestamp_ntz"))
    for load_id, source in enumerate((early, events)):
        load.run_load(spark, source, "events", f"{root}/table", f"{root}/state", load_id, START)
    return sink.read_table(spark, f"{root}/table").select("key", "event_id", "load_id")


@query
def stream_bounded_files(spark, sf):
    """The later half of the events arrives first; one file per batch stores what all at once would."""
    root = work_dir(spark, "bounded")
    events = table(spark, sf, "events")
    late = F.col("ts") >= F.lit(TODAY).cast("timestamp_ntz")
    for part in (events.where(late), events.where(~late)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = views.events_source(continuous.read_stream(spark, f"{root}/in", events.schema, files_per_trigger=1))
    run = continuous.start_load(
        stream, "events", f"{root}/table", f"{root}/state", f"{root}/checkpoint", START, once=True
    )
    run.awaitTermination()
    return sink.read_table(spark, f"{root}/table").select("key", "event_id", "load_id")


@query
def repeat_loads(spark, sf):
    """Rows stored by three loads of an unchanged source: after the first, only those at the mark."""
    root = work_dir(spark, "repeat")
    events = views.src_events(spark, sf)
    for load_id in range(3):
        load.run_load(spark, events, "events", f"{root}/table", f"{root}/state", load_id, START)
    return sink.read_loads(spark, f"{root}/table").groupBy("load_id").agg(F.count("*").alias("n"))


@query
def compact_then_replay(spark, sf):
    """Two loads, a compaction, the second load repeated, a third load: all rows are there."""
    root = work_dir(spark, "compact")
    args = f"{root}/table", f"{root}/state"
    events = views.src_events(spark, sf)
    early = events.where(F.col("ts") < F.lit(YESTERDAY).cast("timestamp_ntz"))
    until = events.where(F.col("ts") < F.lit(TODAY).cast("timestamp_ntz"))
    load.run_load(spark, early, "events", *args, 0, START)
    load.run_load(spark, until, "events", *args, 1, START)
    sink.compact(spark, f"{root}/table")
    load.run_load(spark, until, "events", *args, 1, START)
    load.run_load(spark, events, "events", *args, 2, START)
    return sink.read_table(spark, f"{root}/table").select("key", "event_id", "load_id")


@query
def replay_other_rows(spark, sf):
    """Loads repeated with other rows after a compaction and after a vacuum: what they had replaced is back."""
    path = f"{work_dir(spark, 'other')}/table"
    events = table(spark, sf, "events")
    key = F.col("event_id").cast("string").alias("key")

    def store(load_id, attempt, kind=None):
        rows = events if kind is None else events.where(F.col("event_type") == kind)
        sink.write_load(rows.select(key, "event_type", F.lit(attempt).alias("attempt")), path, load_id)

    store(0, 0)
    store(1, 1, "click")
    store(2, 2, "view")
    sink.compact(spark, path)
    store(1, 3, "purchase")
    sink.compact(spark, path, before_load=2)
    sink.vacuum(spark, path)
    sink.compact(spark, path)
    store(2, 4, "signup")
    return sink.read_table(spark, path).select("key", "event_type", "attempt", "load_id")


@query
def replay_idempotent(spark, sf):
    """The same rows stored by three loads: rows offered against rows kept."""
    root = work_dir(spark, "replay")
    batch = extract.keyed_incremental(views.src_events(spark, sf), START)
    for load_id in (0, 1, 1):
        sink.write_load(batch, f"{root}/table", load_id, UPDATED_MS + load_id)
    offered = sink.read_loads(spark, f"{root}/table")
    kept = sink.read_table(spark, f"{root}/table")
    return _union(
        df.agg(
            F.lit(name).alias("rows"), F.count("*").alias("n"),
            F.min("last_updated_time").alias("first_update"),
        )
        for name, df in (("offered", offered), ("kept", kept))
    )


@query
def late_rows(spark, sf):
    """Events stored up to three days late: those below the mark of the load of 16 January."""
    arrival = F.col("ts") + F.make_dt_interval((F.col("event_id") % 3).cast("int"))
    events = views.src_events(spark, sf).withColumn("arrival", arrival)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    mark = events.where(F.col("arrival") < cut).agg(state.mark_value().alias("mark")).first()[0]
    later = events.where(F.col("arrival") >= cut)
    return state.late_rows(later, mark).select("event_id", "DATETIMESTAMP")


def _ledger(spark, sf) -> DataFrame:
    """Loads of several tables, one absent and one without the incremental field."""
    root = work_dir(spark, "ledger")

    def one(name, source):
        def go():
            return load.run_load(spark, source(), name, f"{root}/{name}", f"{root}/state", 0, START)
        return name, go

    return load.run_all(spark, [
        one("events", lambda: views.src_events(spark, sf)),
        one("absent", lambda: table(spark, sf, "absent")),
        one("orders", lambda: views.src_orders(spark, sf)),
        one("nation", lambda: table(spark, sf, "nation")),
    ])


@query
def run_ledger(spark, sf):
    return _alike(_ledger(spark, sf).select("query", "status", "rows", "error_class"), "rows")


@query
def run_ledger_result(spark, sf):
    return load.run_result(_ledger(spark, sf))


@query
def smoke_run(spark, sf):
    """The first ten rows of every table, keyed and stored, and two sources that fail."""
    root = work_dir(spark, "smoke")

    def one(name, source):
        def go():
            rows = source()
            order = [f.name for f in rows.schema.fields if f.dataType.typeName() != "array"]
            sink.write_load(keys.with_key(extract.smoke_sample(rows, order)), f"{root}/{name}", 0, UPDATED_MS)
            return sink.read_load(spark, f"{root}/{name}", 0).count()
        return name, go

    loads = [one(name, lambda name=name: table(spark, sf, name)) for name in TABLES]
    loads.append(one("absent", lambda: table(spark, sf, "absent")))
    loads.append(one("no_such_column", lambda: table(spark, sf, "orders").where("no_such_column = 1")))
    ledger = load.run_all(spark, loads, parallel=4)
    stored = _union(
        sink.read_load(spark, f"{root}/{name}", 0).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
        .withColumn("query", F.lit(name)) for name in TABLES
    )
    return _alike(ledger.join(stored, "query", "left").select(
        "query", "status", "rows", "error_class", "first_key", "last_key"), "rows")


def _stored_events(spark, sf, root: str) -> dict[str, str]:
    """A table per event type: what came before 20 January stored on the 19th, the rest on the 20th.

    Views carry the field in lower case at first, sign-ups have it from the second load on. Locked is a
    table with a damaged file. The events are split by type in one pass.
    """
    events = views.src_events(spark, sf)
    names = [r.view.lower() for r in views.catalog(spark, sf).collect()]  # one line per table
    columns = events.schema
    events.write.partitionBy("event_type").parquet(f"{root}/in")
    schema = [f for f in columns if f.name != "event_type"]
    early = F.col("ts") < F.lit(TODAY).cast("timestamp_ntz")

    def one(kind):
        path = f"{root}/tb_{kind}"

        def go():
            rows = spark.read.schema(type(columns)(schema)).parquet(f"{root}/in/event_type={kind}")
            if kind in ("view", "signup"):
                kept = keys.with_key(rows.where(F.col("DATETIMESTAMP") >= START))
                lower = kept.withColumnRenamed("DATETIMESTAMP", "datetimestamp")
                first, second = (lower, kept) if kind == "view" else (kept.drop("DATETIMESTAMP"), kept)
                sink.write_load(first.where(early), path, 0, SINCE - 1)
                sink.write_load(second.where(~early), path, 1, SINCE + 1)
                return 0
            load.run_load(spark, rows.where(early), kind, path, f"{root}/state", 0, START, updated_ms=SINCE - 1)
            return load.run_load(spark, rows, kind, path, f"{root}/state", 1, START, updated_ms=SINCE + 1)
        return kind, go

    kinds = [n for n in names if n not in ("absent", "gone", "locked")]
    run = load.run_all(spark, [one(k) for k in kinds], parallel=4)
    failed = run.where("status = 'failure'").select("message").collect()
    if failed:
        raise RuntimeError(failed[0].message)
    stored = keys.with_key(events.limit(10))
    _damaged(spark, f"{root}/tb_locked", stored.withColumn(sink.UPDATED, F.lit(SINCE + 1).cast("long")))
    return {f"tb_{n}": f"{root}/tb_{n}" for n in names}


@query
def inspect_stored(spark, sf):
    """The stored tables inspected on 20 January; one of them cannot be read."""
    tables = _stored_events(spark, sf, work_dir(spark, "inspect"))
    found = inspect.inspect_tables(spark, views.catalog(spark, sf), tables, SINCE, TODAY)
    return found.withColumn("failed", F.col("error").isNotNull()).drop("top_source_days", "error")


@query
def daily_inspection(spark, sf):
    """Two daily inspections of the stored tables: the change per domain on the second day."""
    root = work_dir(spark, "daily")
    tables = _stored_events(spark, sf, root)
    entries, runs = views.catalog(spark, sf), f"{root}/history"
    args = runs, 1, f"{YESTERDAY}T23:00:00Z", TIERED
    jobs.daily_inspection(spark, entries, tables, SINCE_YESTERDAY, YESTERDAY, *args)
    args = runs, 2, f"{TODAY}T23:00:00Z", TIERED
    return jobs.daily_inspection(spark, entries, tables, SINCE, TODAY, *args)[1]


@query
def reconcile_stored(spark, sf):
    """Recorded counts of the event types against the stored tables, of which one cannot be read."""
    tables = _stored_events(spark, sf, work_dir(spark, "reconcile"))
    more = spark.createDataFrame([("tb_locked", 3)], "table string, expected_rows bigint")
    report = jobs.reconcile_sources(spark, views.expected_counts(spark, sf).unionByName(more), tables)
    return report.withColumn("failed", F.col("message").isNotNull()).drop("message")
