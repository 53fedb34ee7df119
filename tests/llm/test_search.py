"""Top-k search against all inner products."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, pivot_search, queries

SF = "/root/testdata/sf0.001"


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_query_equals_sql(spark):
    sys.path.insert(0, "tests")
    from compare import duck, spark_rows, sql_rows

    got = spark_rows(queries.op7_top_k(spark, SF))
    assert got == sql_rows(duck(SF), queries.ORACLE_SQL["op7_top_k"])
    assert len(got[1]) == 50


def test_blocks_ties_and_other_lengths(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-2, 2) for _ in range(4 if i % 7 else 3)]) for i in range(300)] + [(900, [1]), (901, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, vector array<long>, q string, rank int")
    df = df.union(spark.createDataFrame([(None, [1, 1, 1, 1], "", 0), (5000, None, "", 0)], df.schema))
    found = pivot_search.top_k(
        df, F.col("vec_id") % 3 == 0, common.work_dir(spark, "t"), k=4, pivots=3, block=50, query_block=20
    )
    asked = [(i, v) for i, v in rows if i % 3 == 0]
    assert sorted(map(tuple, found.collect())) == brute(rows, asked, 4)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_repeated_rows_are_candidates_of_their_own(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (1, [5, 0]), (1, [5, 0]), (2, [3, 0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    found = pivot_search.top_k(df, F.col("vec_id") == 0, common.work_dir(spark, "t"), k=5)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1, 5), (0, 2, 1, 5), (0, 3, 2, 3)]


def test_unusable_and_empty(spark):
    rows = [(1, [1.0, float("nan")]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r.vec_id for r in df.where(pivot_search.usable("embedding")).collect()] == [5]
    none = df.limit(0).select("vec_id", pivot_search.scaled("embedding").alias("vector"))
    assert pivot_search.top_k(none, F.col("vec_id") > 0, common.work_dir(spark, "t")).count() == 0
    big = spark.createDataFrame([(1, [1 << 40])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="too large"):
        pivot_search.top_k(big, F.col("vec_id") > 0, common.work_dir(spark, "t")).collect()


def table_of(x, pivots):
    return np.sqrt(((x[:, None, :].astype(float) - pivots[None]) ** 2).sum(2))


def plain(asked, q, ids, x, k):
    scores = [[sum(int(a) * int(b) for a, b in zip(v, w)) for w in x] for v in q]
    return [
        (r, s, i) for r, own in enumerate(asked)
        for s, i in sorted(((s, int(i)) for s, i in zip(scores[r], ids) if i != own), key=lambda t: (-t[0], t[1]))[:k]
    ]


def test_bounds_skip_candidates(monkeypatch):
    monkeypatch.setattr(pivot_search, "TILE", 50)
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (20, 8))
    x = (centres[rng.integers(0, 20, 2000)] + rng.integers(-4, 5, (2000, 8))).astype(np.int64)
    d, ids, some = table_of(x, x[:32]), np.arange(2000), np.arange(0, 2000, 100)
    seen = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda s, *a, **o: seen.append(s.size) or partition(s, *a, **o))
    got = pivot_search.best_of(some, x[some], d[some], ids, x, d, 5)
    assert list(zip(*(a.tolist() for a in got))) == plain(some, x[some], ids, x, 5)
    assert sum(seen) < len(some) * len(x)


@pytest.mark.parametrize("dim", [3, 2048])
def test_largest_components_do_not_overflow(dim):
    """Components of almost 2**26, many dimensions: bounds and scores near the end of a long."""
    rng = np.random.default_rng(dim)
    top = pivot_search.LIMIT - 1
    x = rng.choice([top, -top, top - 1], (60, dim))
    x[:5] = top
    d, ids = table_of(x, x[10:14]), np.arange(60)
    got = pivot_search.best_of(ids[:6], x[:6], d[:6], ids, x, d, 4)
    assert list(zip(*(a.tolist() for a in got))) == plain(ids[:6], x[:6], ids, x, 4)
