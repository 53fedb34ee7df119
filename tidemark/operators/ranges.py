"""Row numbers and running sums over a whole order, in ranges of it.

A window without a partition puts all rows into one task. Here rows are split into ranges of the
order, each task numbers and adds up its own, and the totals of the ranges before, one line per
range, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import work_dir

PLACE = "place"


def running(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), place: str = PLACE) -> DataFrame:
    """All rows with their `place` in the order, from 1, and of each column in `sums` the sum up to
    the row, `<column>_so_far`, and over all rows, `<column>_total`.

    Nulls in `sums` add nothing; up to the first other value the sum is 0, and so is the total of
    none. Rows that are equal in the whole order get different places in any order and meet in one
    task, so the order should end in a column that tells rows apart. A column of `df` with the name
    of a new one is an error. The ranges are written once below the shared folder: bounds are
    sampled, so a second pass over the plan could draw them elsewhere.
    """
    spark = df.sparkSession
    new = [place, *(f"{c}_{kind}" for c in sums for kind in ("so_far", "total"))]
    clash = {c.lower() for c in new} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"rows already have columns named {sorted(clash)}")
    folder = work_dir(spark, "ranges")
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(folder)
    rows = spark.read.schema(ranged.schema).parquet(folder)
    added = [F.coalesce(F.sum(c), F.lit(0)).alias(f"_{i}") for i, c in enumerate(sums)]
    totals = rows.groupBy("_range").agg(F.count("*").alias("_n"), *added)
    lines = sorted(totals.collect())  # one per range
    start, starts = [x * 0 for x in lines[0][1:]] if lines else [0] * (1 + len(sums)), []
    for line in lines:
        starts.append((line[0], *start))
        start = [a + b for a, b in zip(start, line[1:])]
    before = spark.createDataFrame(starts, totals.schema)
    here = Window.partitionBy("_range").orderBy(*order)
    up_to = here.rowsBetween(Window.unboundedPreceding, 0)
    # The window comes first, so that it does not sort the columns that are added.
    columns = [F.row_number().over(here).alias("_at")]
    columns += [F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"_up_{i}") for i, c in enumerate(sums)]
    numbered = rows.select("*", *columns).join(F.broadcast(before), "_range")
    found = [(F.col("_at") + F.col("_n")).alias(place)]
    for i, c in enumerate(sums):
        found.append((F.col(f"_up_{i}") + F.col(f"_{i}")).alias(f"{c}_so_far"))
        found.append(F.lit(start[1 + i]).cast(totals.schema[f"_{i}"].dataType).alias(f"{c}_total"))
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], *found)
