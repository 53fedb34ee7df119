"""Load planning: volume tiers, orders, and the balanced split over extractors.

Inputs have one row per table of a catalogue: `name`, `tier`, `n` (rows, null when not counted)
and for the split `place` (order of the source list). Their size is the number of tables. Places and
shares come from ranges of the order, for plans of any size; the split folds over a plan in one
task, and `one_plan` makes sure that it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.classify import LOAD_ORDER, SPLIT_ORDER, tier_of_volume, tier_rank
from tidemark.operators.ranges import running

TOTAL = "total"
MOST_TABLES = 100_000


def one_plan(tables: DataFrame) -> DataFrame:
    """The plan, if it has one line per table of a catalogue: more than `MOST_TABLES` lines are an error."""
    if tables.limit(MOST_TABLES + 1).count() > MOST_TABLES:
        raise ValueError(f"a load plan has at most {MOST_TABLES} lines")
    return tables


def with_tier(tables: DataFrame, **bounds) -> DataFrame:
    return tables.withColumn("tier", tier_of_volume(F.col("n"), **bounds))


def tier_volume_summary(tables: DataFrame) -> DataFrame:
    """Tables, rows and share of the counted rows per tier, and in total over the counted tables.

    A tier never counted has null rows.
    """
    grouped = tables.rollup("tier").agg(
        F.grouping("tier").alias("all"),
        F.count("*").alias("views"),
        F.count("n").alias("counted"),
        F.sum("n").alias("rows"),
    )
    overall = F.col("all") == 1
    total = F.max(F.when(overall, F.col("rows"))).over(Window.partitionBy())
    return grouped.select(
        F.when(overall, TOTAL).otherwise(F.col("tier")).alias("tier"),
        F.when(overall, F.col("counted")).otherwise(F.col("views")).alias("views"),
        "rows",
        (F.col("rows").cast("double") * 100 / total).alias("pct"),
    )


def volume_concentration(tables: DataFrame) -> DataFrame:
    """Counted tables from the largest down, with the share of all rows up to each."""
    counted = tables.where(F.col("n").isNotNull()).select("name", "n")
    ranked = running(counted, [F.desc("n"), F.asc("name")], ["n"], "top")
    return ranked.select(
        F.col("top").cast("int"), "name", "n", (F.col("n_so_far").cast("double") * 100 / F.col("n_total")).alias("cum_pct")
    )


def small_first_order(tables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The load queue: by tier, small tables first, uncounted ones by name; one queue per `by`."""
    order = [tier_rank(F.col("tier"), LOAD_ORDER), F.coalesce("n", F.lit(0)), F.col("name")]
    if not by:
        return running(tables, order, place="queue_place").withColumn("queue_place", F.col("queue_place").cast("int"))
    return tables.withColumn("queue_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def balanced_split(tables: DataFrame, workers: int, plan: str | None = None) -> DataFrame:
    """Assign every table to a worker, class by class.

    Within a class tables go from large to small, equal sizes in source order; each goes to the
    worker with the fewest tables of that class, then with the fewest rows in total, then with
    the lowest number. Each choice depends on all before it, so one task folds over the tables of
    a plan; `plan` names a column when several plans are split at once. Rows were counted before:
    only one line per table arrives here.
    """
    if plan is None:
        whole = one_plan(tables).withColumn("plan", F.lit(0))
        return balanced_split(whole, workers, "plan").drop("plan")
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in tables.schema.fields]

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["n"].fillna(0)
        rank = pdf["tier"].map({t: i for i, t in enumerate(SPLIT_ORDER)})
        ordered = pd.DataFrame({"rank": rank, "size": size, "place": pdf["place"], "tier": pdf["tier"]})
        ordered = ordered.sort_values(["rank", "size", "place"], ascending=[True, False, True])
        rows = [0] * workers
        items: dict[tuple[str, int], int] = {}
        chosen = {}
        for index, tier, n in zip(ordered.index, ordered["tier"], ordered["size"]):
            w = min(range(workers), key=lambda i: (items.get((tier, i), 0), rows[i], i))
            items[tier, w] = items.get((tier, w), 0) + 1
            rows[w] += int(n)
            chosen[index] = w + 1
        return pdf.assign(worker=pd.Series(chosen, dtype="int32"))

    return tables.groupBy(plan).applyInPandas(assign, ", ".join([*columns, "worker int"]))


def split_summary(assigned: DataFrame) -> DataFrame:
    """Tables and rows per worker and tier, and per worker in total."""
    return assigned.rollup("worker", "tier").agg(
        F.grouping("worker").alias("all"), F.grouping("tier").alias("whole"),
        F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    ).where("all = 0").select(
        "worker", F.when(F.col("whole") == 1, TOTAL).otherwise(F.col("tier")).alias("tier"), "items", "rows"
    )


def split_order(assigned: DataFrame) -> DataFrame:
    """Each worker's own small-first queue."""
    return small_first_order(assigned, by=["worker"])


def merge_catalogues(existing: DataFrame, new: DataFrame, key: str = "table") -> DataFrame:
    """Existing entries and the new ones for other tables; one entry per table, existing kept."""
    both = existing.withColumn("source_rank", F.lit(0)).unionByName(
        new.withColumn("source_rank", F.lit(1))
    )
    rest = [c for c in existing.columns if c != key]
    return both.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct("source_rank", *rest)).alias("row")
    ).select(key, "row.*")


def compare_catalogues(legacy: DataFrame, live: DataFrame) -> DataFrame:
    """Per table: dropped, added, re-keyed or kept between two generations (`table`, `key_columns`)."""
    old = legacy.select("table", F.col("key_columns").alias("legacy_key"))
    new = live.select("table", F.col("key_columns").alias("live_key"))
    return old.join(new, "table", "full_outer").withColumn(
        "change",
        F.when(F.col("live_key").isNull(), "dropped")
        .when(F.col("legacy_key").isNull(), "added")
        .when(F.col("legacy_key") != F.col("live_key"), "rekeyed")
        .otherwise("kept"),
    )


def catalog_filter(
    catalog: DataFrame, domains: Sequence[str], tiers: Sequence[str], tiered_domains: Sequence[str]
) -> DataFrame:
    """Entries of the domains; the tier only decides in tiered domains."""
    domain = F.col("domain")
    return catalog.where(
        domain.isin(*domains) & (~domain.isin(*tiered_domains) | F.col("tier").isin(*tiers))
    )


def single_table_filter(catalog: DataFrame, table: str) -> DataFrame:
    """The entries of one table whatever their domain and tier, or a made-up one if there is none."""
    found = catalog.where(F.col("table") == table).select("domain", "view", "table", "tier")
    made_up = found.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("custom").alias("domain"), F.lit(table).alias("view"), F.lit(table).alias("table"),
        F.lit("-").alias("tier"),
    )
    return found.unionByName(made_up)


def catalog_x_rows(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """Catalogue entries in their order with the row count of their table, null when absent."""
    return catalog.join(counts, "table", "left").select(
        "place", "domain", "view", "table", "tier", F.col("n").alias("stored_rows")
    )
