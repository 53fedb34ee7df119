"""Keyed tables: one row per key, the last write wins.

A table is a parquet folder with one sub-folder per load. A load only ever writes its own
sub-folder, so repeating it after a failure replaces its own rows and nothing else, and the
cost of a load follows the rows of the load, not the rows of the table. Reading collapses the
loads.

`compact` does that once for the rows so far. It writes them beside the loads, as a base, and then
the list of the files they came from. Readers take the base and every file that is not in its
list. A folded load that has such a file was repeated since: its rows in the base no longer count,
and where they had replaced rows of earlier loads, those are read again. So loads and streams go
on writing as before, and a repeated load replaces its rows whether it was folded or not.

`vacuum` removes the files of folded loads, which from then on cannot be repeated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOAD = "load_id"
UPDATED = "last_updated_time"
COLUMNS = "columns"
# Folders beside the loads; readers of loads do not look into them.
SCHEMAS, BASES, FOLDED, SETTLED = "_schemas", "_base", "_folded", "_settled"
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def last_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by `order`, ties by the other columns.

    An aggregate, not a window: each task first reduces its rows to one per key, so a key that
    holds a large part of the rows never meets in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    if any(unordered(f.dataType) for f in df.schema.fields if f.name in rest):
        row = F.max_by(F.struct(*order, *rest), F.struct(*order))
    else:
        row = F.max(F.struct(*order, *rest))
    picked = df.groupBy(*keys).agg(row.alias("row"))
    return picked.select(*[c if c in keys else F.col("row").getField(c).alias(c) for c in df.columns])


def unordered(dtype: T.DataType) -> bool:
    """Whether values of a type cannot be compared."""
    if isinstance(dtype, T.StructType):
        return any(unordered(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return unordered(dtype.elementType)
    return isinstance(dtype, (T.MapType, T.VariantType))


def upsert(
    existing: DataFrame, batch: DataFrame, key: str, order: Sequence[str]
) -> DataFrame:
    """Existing and new rows merged to one row per key. Rows without a key are not kept."""
    merged = existing.unionByName(batch, allowMissingColumns=True)
    return last_per_key(merged.where(F.col(key).isNotNull()), key, order)


def null_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """Rows that cannot be stored because a part of their business key is null."""
    return df.where(F.col(key).isNull())


def upsert_stats(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows offered, keys kept and the difference; a difference means duplicate keys."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("rows_offered"), F.count_distinct(F.col(key)).alias("keys_kept")
    )
    return counts.withColumn("duplicate_rows", F.col("rows_offered") - F.col("keys_kept"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that do not identify one row: those of several rows, and the null key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.where((F.col("n") > 1) | F.col(key).isNull())


def schemaless(df: DataFrame, key: str = "key") -> DataFrame:
    """The key and all other columns as one VARIANT, for sources whose columns change their types."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != key]
    return df.select(key, F.to_variant_object(F.struct(*rest)).alias(COLUMNS))


def write_load(
    df: DataFrame,
    path: str,
    load_id: int,
    updated_ms: int | None = None,
    rows_per_file: int | None = None,
) -> None:
    """Store the rows of one load. Running the same load again replaces them.

    A load whose files `vacuum` has removed is an error.
    """
    settled = _settled(df.sparkSession, path)
    if settled and load_id <= settled["load"]:
        raise ValueError(f"{path}: loads up to {settled['load']} are settled, {load_id} cannot be repeated")
    taken = {LOAD} if updated_ms is None else {LOAD, UPDATED}
    if taken & {c.lower() for c in df.columns}:
        raise ValueError(f"rows already have a column named {sorted(taken)}")
    if updated_ms is not None:
        df = df.withColumn(UPDATED, F.lit(updated_ms).cast("long"))
    writer = df.write.mode("overwrite")
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(f"{path}/{LOAD}={load_id}")
    _keep_schema(df, path, load_id)


def _keep_schema(df: DataFrame, path: str, load_id: int) -> None:
    """Note the columns of a load beside the table, unless a load before had the same."""
    text = df.schema.json()
    digest = hashlib.md5(text.encode()).hexdigest()
    line = json.dumps({LOAD: load_id, "schema": text})
    row = df.sparkSession.range(1).select(F.lit(line).alias("value"))
    row.coalesce(1).write.mode("ignore").text(f"{path}/{SCHEMAS}/{digest}")


def table_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns of all loads in the order of their first load; None if none were noted.

    Spellings of a name that differ in case are one column, named as in its first load, unless the
    session tells them apart. A column whose type has changed makes the table unreadable;
    `schemaless` rows avoid that.
    """
    try:
        lines = [json.loads(r[0]) for r in spark.read.text(f"{path}/{SCHEMAS}/*").collect()]
    except AnalysisException as e:
        if e.getCondition() in ABSENT:
            return None
        raise
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    fields: dict[str, T.StructField] = {}
    for line in sorted(lines, key=lambda x: (x[LOAD], x["schema"])):
        for f in T.StructType.fromJson(json.loads(line["schema"])).fields:
            known = fields.setdefault(f.name if exact else f.name.lower(), T.StructField(f.name, f.dataType))
            if known.dataType != f.dataType:
                raise ValueError(f"{path}: column {f.name!r} is {known.dataType} and {f.dataType}")
    return T.StructType(list(fields.values()))


def _read(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None, base: str | None = None):
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    if base is not None:
        reader = reader.option("basePath", base)
    try:
        return reader.parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() in ABSENT:
            return None
        raise


def _bases(spark: SparkSession, path: str) -> int | None:
    """The number of the current base: the last one whose list of files is complete."""
    done = _read(spark, [f"{path}/{FOLDED}"], T.StructType.fromDDL("file string, load bigint, base int"))
    return None if done is None else done.agg(F.max("base")).first()[0]


def _settled(spark: SparkSession, path: str) -> Row | None:
    """The base whose loads cannot be repeated any more, and the last of them."""
    noted = _read(spark, [f"{path}/{SETTLED}"], T.StructType.fromDDL("load bigint, base int"))
    return None if noted is None else noted.orderBy(F.col("base").desc()).first()


def _load_of(file: str) -> int:
    """The load that a listed file belongs to."""
    return int(file.rpartition(f"{LOAD}=")[2].partition("/")[0])


class _Files:
    """What a table consists of: its base, and the files of loads by what the base knows of them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None):
        self.spark, self.path = spark, path
        number = T.StructField(LOAD, T.LongType())
        self.loads = _read(spark, [path], None if schema is None else T.StructType([*schema.fields, number]))
        self.base = None if self.loads is None else _bases(spark, path)
        if self.loads is None:
            return
        self.schema = T.StructType([f for f in self.loads.schema.fields if f.name != LOAD] + [number])
        self.listed = list(self.loads.inputFiles())
        lines = []
        if self.base is not None:
            listing = T.StructType.fromDDL("file string, load bigint")
            lines = _read(spark, [f"{path}/{FOLDED}/base={self.base}"], listing).collect()  # as in any listing
        names = {r.file for r in lines}
        self.new = [f for f in self.listed if f.rpartition("/")[2] not in names]
        self.old = [f for f in self.listed if f.rpartition("/")[2] in names]
        self.repeated = {r.load for r in lines} & {_load_of(f) for f in self.new}

    def files(self, names: list[str]) -> list[DataFrame]:
        return [_read(self.spark, names, self.schema, self.path).select(*self.schema.names)] if names else []

    def base_rows(self, base: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{BASES}/{base}")

    def rows(self, key: str, before_load: int | None = None) -> DataFrame:
        """Rows of all loads, or of those before one; rows that a later load replaced may be missing."""
        if self.base is None:
            rows = self.loads.withColumn(LOAD, F.col(LOAD).cast("long"))
            return rows if before_load is None else rows.where(F.col(LOAD) < before_load)
        gone = F.col(LOAD).isin(*self.repeated) if self.repeated else F.lit(False)
        if before_load is not None:
            gone = gone | (F.col(LOAD) >= before_load)
        base = self.base_rows(self.base)
        parts = [base.where(~gone)]
        if self.repeated or before_load is not None:
            # rows of earlier loads that a row which no longer counts had replaced
            stale = base.where(gone).select(F.col(key).alias("_key"))
            earlier = self.files([f for f in self.old if _load_of(f) not in self.repeated])
            settled = _settled(self.spark, self.path)
            if settled is not None and settled["base"] != self.base:
                earlier.append(self.base_rows(settled["base"]))
            parts += [e.where(~gone).join(stale, F.col(key) == F.col("_key"), "left_semi") for e in earlier]
        new = self.new if before_load is None else [f for f in self.new if _load_of(f) < before_load]
        return reduce(DataFrame.union, [p.select(*self.schema.names) for p in parts + self.files(new)])


def read_loads(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    since_load: int | None = None,
    key: str = "key",
) -> DataFrame | None:
    """The rows of all loads of a table, collapsed or not, or None when nothing was ever stored.

    The columns are those noted by the loads, or else those of all footers. `since_load` leaves
    out earlier loads. Rows in a base keep the number of their load. `key` is needed where a
    folded load was repeated: the keys it had are looked up in the loads before it.
    """
    found = _Files(spark, path, schema or table_schema(spark, path))
    if found.loads is None:
        return None
    rows = found.rows(key)
    return rows if since_load is None else rows.where(F.col(LOAD) >= since_load)


def read_load(
    spark: SparkSession, path: str, load_id: int, schema: T.StructType | None = None
) -> DataFrame:
    """The rows of one load, reading no other."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{LOAD}={load_id}")


def read_table(
    spark: SparkSession,
    path: str,
    key: str = "key",
    since_load: int | None = None,
    schema: T.StructType | None = None,
) -> DataFrame | None:
    """The table as stored: one row per key, of the latest load that wrote it.

    `since_load` keeps the keys written by that load or a later one. Their latest row is in one
    of these loads, so the others are not read.
    """
    loads = read_loads(spark, path, schema, since_load, key)
    return None if loads is None else collapse(loads, key, [LOAD])


def collapse(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, for stored rows of which most have a key of their own.

    A first pass over the keys alone finds those of several rows; only their rows are shuffled
    and sorted whole, the others pass through. Rows without a key are not kept.
    """
    several = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    several = several.agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    single = rows.where(F.col(key).isNotNull()).join(several, F.col(key) == F.col("_key"), "left_anti")
    rest = rows.join(several, F.col(key) == F.col("_key"), "left_semi")
    return single.unionByName(last_per_key(rest, key, order))


def compact(spark: SparkSession, path: str, key: str = "key", before_load: int | None = None) -> None:
    """Collapse the rows so far into a new base. Readers use it once its list of files is written.

    `before_load` leaves that load and later ones as they are, so that `vacuum` may remove the
    files of the others. A run that fails before the list is written leaves the table as it was
    and is simply repeated.
    """
    found = _Files(spark, path, table_schema(spark, path))
    if found.loads is None:
        raise ValueError(f"nothing stored at {path}")
    settled = _settled(spark, path)
    if settled and before_load is not None and before_load <= settled["load"]:
        raise ValueError(f"{path}: loads up to {settled['load']} are settled, they stay in the base")
    base = (found.base or 0) + 1
    taken = [f for f in found.listed if before_load is None or _load_of(f) < before_load]
    rows = collapse(found.rows(key, before_load), key, [LOAD])
    rows.write.mode("overwrite").parquet(f"{path}/{BASES}/{base}")
    lines = [(f.rpartition("/")[2], _load_of(f)) for f in taken]
    folded = spark.createDataFrame(lines, "file string, load bigint").coalesce(1)
    folded.write.mode("overwrite").parquet(f"{path}/{FOLDED}/base={base}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the files of the loads that the base holds, and bases before it. Returns the loads removed.

    These loads are settled then: storing one of them again is an error. That is noted first, so
    a run that fails is simply repeated. Loads repeated since the compaction must be compacted
    before. Readers that listed the files earlier must start again. So the listing of a table
    holds the loads since its last vacuum, however many there were.
    """
    found = _Files(spark, path, table_schema(spark, path))
    if found.loads is None or found.base is None:
        raise ValueError(f"no base at {path}")
    if found.repeated:
        raise ValueError(f"{path}: loads {sorted(found.repeated)} were repeated, compact first")
    loads = sorted({_load_of(f) for f in found.old})
    settled = _settled(spark, path)
    if loads:
        later = [n for n in (_load_of(f) for f in found.new) if n <= loads[-1]]
        if later:
            raise ValueError(f"{path}: loads {sorted(set(later))} are not in the base, compact first")
        last = max(loads[-1], settled["load"]) if settled else loads[-1]
        note = spark.createDataFrame([(last,)], "load bigint").coalesce(1)
        note.write.mode("overwrite").parquet(f"{path}/{SETTLED}/base={found.base}")
    elif settled is None or settled["base"] != found.base:
        return 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    stale = [f"{path}/{LOAD}={n}" for n in loads]
    for kind, name in ((BASES, ""), (FOLDED, "base="), (SETTLED, "base=")):
        stale += [f"{path}/{kind}/{name}{n}" for n in range(1, found.base)]
    for folder in stale:
        files.delete(hadoop(folder), True)
    return len(loads)
