"""Run history as JSON lines, and change against the previous run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.stats import summary_by_domain, summary_by_tier

DOMAIN = "struct<tables: bigint, ok: bigint, missing: bigint, errors: bigint, upd_today: bigint, " \
    "src_today: bigint, src_old: bigint, dup_keys: bigint, reupsert: bigint>"
TIER = "struct<tables: bigint, upd_today: bigint, src_today: bigint, src_old: bigint>"
LINE = (
    "seq bigint, day string, generated_at string, "
    f"summary struct<by_domain: map<string, {DOMAIN}>, by_tier: map<string, {TIER}>>"
)


def _as_map(df: DataFrame, key: str, name: str) -> DataFrame:
    values = [c for c in df.columns if c != key]
    return df.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.struct(*values))))).alias(name)
    )


def history_entry(
    stats: DataFrame,
    tiered_domains: Sequence[str],
    seq: int,
    day: str,
    generated_at: str,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """One run as one row: summaries, the statistics of every table and constant labels.

    The statistics, one row per table of the catalogue, are computed once and held by the driver,
    because three results derive from them. The collected lists have one element per domain, per
    tier and per table.
    """
    stats = stats.sparkSession.createDataFrame(stats.collect(), stats.schema)
    parts = (
        _as_map(summary_by_domain(stats), "domain", "by_domain"),
        _as_map(summary_by_tier(stats, tiered_domains), "tier", "by_tier"),
        stats.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("tables")),
    )
    domains, tiers, tables = (p.withColumn("seq", F.lit(seq).cast("long")) for p in parts)
    return domains.join(tiers, "seq").join(tables, "seq").select(
        "seq",
        F.lit(day).alias("day"),
        *[F.lit(value).alias(name) for name, value in (labels or {}).items()],
        F.lit(generated_at).alias("generated_at"),
        F.struct("by_domain", "by_tier").alias("summary"),
        "tables",
    )


def append_history(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the history; text that is no JSON object is left out.

    `position` orders lines that carry no `seq` as they stand in their files.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.struct(
            meta["file_modification_time"], meta["file_path"], meta["file_block_start"],
            F.monotonically_increasing_id().alias("row"),
        ).alias("position"),
    )
    return parse_history(lines)


def parse_history(lines: DataFrame) -> DataFrame:
    """Parse a `line` column, skipping blank and malformed lines."""
    bad = "_corrupt"
    parsed = F.from_json(
        "line", f"{LINE}, {bad} string", {"columnNameOfCorruptRecord": bad, "mode": "PERMISSIVE"}
    )
    kept = lines.where(F.trim("line") != "").withColumn("entry", parsed)
    seq = F.col("seq") if "seq" in lines.columns else F.col("entry.seq").alias("seq")
    return kept.where(F.col(f"entry.{bad}").isNull()).select(
        *[c for c in lines.columns if c not in ("line", "seq")],
        seq,
        F.col("entry.day").alias("day"),
        F.col("entry.summary").alias("summary"),
    )


def history_previous(history: DataFrame, today: str) -> DataFrame:
    """The last entry in line order of another day than today; later days qualify too."""
    other = history.where(F.col("day").isNull() | (F.col("day") != today))
    order = [c for c in ("seq", "position") if c in history.columns]
    last = other.agg(F.max_by(F.struct("seq", "day", "summary"), F.struct(*order)).alias("last"))
    return last.where(F.col("last").isNotNull()).select("last.*")


def day_over_day_delta(by_domain: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows updated per domain against the previous run, signed; blank without a previous value."""
    before = previous.select(F.explode("summary.by_domain").alias("domain", "counters")).select(
        "domain", F.col("counters.upd_today").alias("prev_upd")
    )
    change = F.format_string("%+d", F.col("upd_today") - F.col("prev_upd"))
    return by_domain.join(before, "domain", "left").select(
        "domain", "upd_today", "prev_upd",
        F.when(F.col("prev_upd").isNotNull(), change).otherwise("").alias("delta"),
    )
