import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("llm-tests")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "6").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


EDGES = [
    (1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b c 's <|endoftext|> 日本"), (5, "word " * 30000),
    (None, "no id"), (-7, "  \n\t "),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns named like results."""
    rows = [(k, t, 9, "x", 1.5) for k, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string, piece double").repartition(3)
