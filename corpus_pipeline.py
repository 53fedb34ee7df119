"""Corpus pipeline: documents in a known language, one of each group of near copies, none with benchmark items, packed.

Each stage works on all rows that the one before kept and returns the columns of its input, whatever their names; the
last returns the places of the documents' pieces. Null ids and repeated rows pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, contamination, language, near_dedup, queries

MIN_SCORE = 0.3


def _boxed(docs: DataFrame) -> DataFrame:
    """The text, and the other columns as one, so that no name clashes with those of an operator."""
    cells = [F.lit(0).alias("cx") if c == "text" else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(F.struct(*cells).alias("row"), "text")


def _unboxed(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col("text") if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: ``MIN_SCORE`` or more of the letters are in known words.

    A mix of learned languages is known. Null and empty texts, texts without letters, and texts mostly in scripts that
    no language uses, or of words unlike those of all languages, go. The languages are learned from the labelled
    documents.
    """
    found = language.identify(_boxed(docs), queries.language_model(spark, sf_dir), evidence_col="evidence")
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("evidence") >= MIN_SCORE))
    return _unboxed(kept, docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of each class of near copies. Rows without words are alone in their class and stay.

    Rows are numbered as they are read, and written with their numbers: a second scan may be split in another way.
    """
    folder = common.work_dir(spark, "pipeline-dedup")
    rows = common.written(_boxed(docs).withColumn("n", F.monotonically_increasing_id()), f"{folder}/numbered")
    found = near_dedup.near_duplicates(rows.select("n", "text"), folder, id_col="n")
    copies = found.where("doc_id <> class_id").select(F.col("doc_id").alias("n"))
    return _unboxed(rows.join(copies, "n", "left_anti"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no item of the benchmark."""
    benchmark = queries.table(spark, sf_dir, "benchmark")
    found = contamination.leaks(_boxed(docs), benchmark, common.work_dir(spark, "pipeline-leaks"))
    return _unboxed(found.where(F.size("leaks") == 0), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into sequences."""
    return queries.packed(spark, docs)


STAGES = [
    ("language_id", language_id), ("near_dedup", one_of_each), ("decontamination", decontaminate), ("packing", pack),
]
ORACLE_SQL = None  # languages, near copies and packing have no SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = common.work_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
