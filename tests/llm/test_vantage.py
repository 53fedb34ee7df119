"""Nearest vectors against all inner products: exact with factor one, recall with the factor of production."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, queries, vantage

SF = "/root/testdata/sf0.01"


def brute(rows, asked, k):
    """(query_id, rank, vec_id, score) of the best by score, ties to the smaller id."""
    out = []
    for q in sorted({i for i, _ in asked}):
        asking = {tuple(w) for j, w in asked if j == q}
        seen = sorted(
            (-float((np.array(v) * np.array(w)).sum()), i) for i, v in rows for w in asking if i != q and len(w) == len(v)
        )
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(seen[:k])]
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if usable(r.embedding)]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = queries.op13_vantage(spark, SF)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    found = sorted(map(tuple, found.collect()))
    assert [r[:2] for r in found] == [r[:2] for r in want]
    hits = len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want})
    assert hits >= 0.9 * len(want)
    vectors = dict(rows)
    for q, _, v, score in found:
        assert score == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[v], float))), abs=1e-9)


def test_recall_in_many_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 4000)] + 0.4 * rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vantage.nearest(df, F.col("vec_id") % 20 == 0, common.work_dir(spark, "t"), shard=500, query_block=64).collect()
    assert len(found) == 200 * 20
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    want = {(q, int(v)) for q in range(0, 4000, 20) for v in np.argsort(-scores[q])[:20]}
    assert len({(r.query_id, r.vec_id) for r in found} & want) >= 0.9 * len(want)


@pytest.mark.parametrize("shard,block", [(40, 15), (10**6, 10**6)])
def test_factor_one_is_exact(spark, shard, block):
    """Whole numbers, so that scores tie; other lengths; unusable vectors; columns named like results."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(5 if i % 9 else 3)]) for i in range(400)]
    rows += [(i + 1000, [1.0, 2.0, 3.0, 0.0, 1.0]) for i in range(60)]  # copies
    bad = [(None, [1.0] * 5), (2000, None), (2020, [0.0] * 5), (2040, [1.0, None]), (2060, [float("nan")] * 5), (2080, []), (2100, [float("inf")])]
    df = spark.createDataFrame([(i, v, 7, "x", 1.0) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int, dim string, score double")
    found = vantage.nearest(
        df, F.col("vec_id") % 20 == 0, common.work_dir(spark, "t"), k=6, factor=1.0, shard=shard, query_block=block
    )
    kept = [r for r in rows if any(r[1])]
    assert sorted(map(tuple, found.collect())) == brute(kept, [r for r in kept if r[0] % 20 == 0], 6)


def test_few_and_no_rows(spark):
    """Fewer candidates than asked for, repeated rows, a query alone, an empty table, a factor below one."""
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (3, [-1.0, 0.0]), (20, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = F.col("vec_id") % 20 == 0
    found = sorted(map(tuple, vantage.nearest(df, ask, common.work_dir(spark, "t")).collect()))
    assert found == [(0, 1, 1, 2.0), (0, 2, 1, 2.0), (0, 3, 3, -1.0)]
    assert vantage.nearest(df.where("false"), ask, common.work_dir(spark, "t")).count() == 0
    assert vantage.nearest(df, F.lit(None).cast("boolean"), common.work_dir(spark, "t")).count() == 0
    with pytest.raises(ValueError, match="factor"):
        vantage.nearest(df, ask, common.work_dir(spark, "t"), factor=0.5)


def test_a_greater_factor_visits_less():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    tree = vantage.Tree(x, float(np.sqrt((x * x).sum(1).max())))
    visits = []
    for factor in (1.0, 2.0, 4.0):
        asking = vantage.Asking(tree, x[:100], np.full(100, -np.inf), 10, factor)
        asking.visit(tree.root, np.arange(100))
        visits.append(asking.visited)
        if factor == 1.0:
            assert np.allclose(asking.scores, -np.sort(-(x[:100] @ x.T), 1)[:, :10])
    assert visits[0] > visits[1] > visits[2]
