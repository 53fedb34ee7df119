"""Exact top-k inner-product search by pivot-table elimination.

Distances of every vector to a few pivots are computed once. By the triangle inequality, the largest difference of
two vectors' pivot distances bounds their distance from below, and with their norms their inner product from above.
Candidates are evaluated in the order of that bound until no bound left reaches the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

PIVOTS = 32
BLOCK = 4096
QUERY_BLOCK = 1024
TILE = 512
LIMIT = 1 << 26  # of a component's size, so that scores of up to 2**11 dimensions fit a long


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def scaled(vector: str, factor: float = 256.0) -> Column:
    """Components as floor(factor * x), computed in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def top_k(
    vectors: DataFrame, is_query: Column, folder: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector",
    pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Each query row's ``k`` best other rows: ``query_id, rank, <id>, score``; fewer if there are fewer.

    ``vector`` holds longs below 2**26 in size (larger ones raise an error), ``is_query`` picks the queries. Rows with
    null vectors or ids take no part; vectors of other lengths than the query's are no candidates. Equal scores go to
    the smaller id; a row is no candidate of a query with the same id; repeated rows are candidates of their own.

    Queries and candidates meet in blocks of at most ``query_block`` and ``block`` rows, one task per pair of blocks,
    each keeping ``k`` rows per query. The pivots, ``pivots`` rows per length with the smallest hashed ids, only
    tighten the bounds; any choice gives the same rows.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    ).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("dim", F.size("v"))
    dims = [r.dim for r in rows.select("dim").distinct().collect()]
    chosen: dict[int, np.ndarray] = {}
    for dim in dims:
        found = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
        chosen[dim] = np.array([r.v for r in found], np.float64).reshape(len(found), dim)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 8192):
            v = batch.column(1)
            dim = batch.column(3).to_numpy(zero_copy_only=False)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and np.abs(flat).max() >= LIMIT:
                raise ValueError("a component is too large for exact scores")
            ends = np.cumsum(dim)
            distances = np.empty(len(dim), object)
            for d in np.unique(dim):
                mine = np.flatnonzero(dim == d)
                x = flat[(ends[mine] - d)[:, None] + np.arange(d)].astype(np.float64)
                p = chosen[int(d)]
                # Sums of squared differences of whole numbers: exact but for the root.
                found = np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in p], 1)
                for at, one in zip(mine, found):
                    distances[at] = one
            column = pa.array(list(distances), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "d"])

    tabled = rows.mapInArrow(table, "id long, v array<long>, q boolean, dim int, d array<double>")
    tabled = common.written(tabled, f"{folder}/pivot-table")
    sizes = {
        r.dim: (r.n, r.m) for r in tabled.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("m")).collect()
    }
    blocks = F.create_map(*(F.lit(x) for d, (n, _) in sizes.items() for x in (d, -(-n // block)))) if sizes else None
    if blocks is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    turns = F.create_map(*(F.lit(x) for d, (_, m) in sizes.items() for x in (d, max(1, -(-m // query_block)))))
    # A row's block is drawn by its whole content, so equal ids spread as well.
    home = F.xxhash64("id", "d")
    n_blocks, n_turns = blocks[F.col("dim")], turns[F.col("dim")]
    columns = [F.col(c).alias(c) for c in ("id", "v", "d", "dim")]
    candidates = tabled.select(
        *columns, F.pmod(home, n_blocks).cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0), (n_turns - 1).cast("int"))).alias("t"),
    )
    asked = tabled.where("q").dropDuplicates(["id", "v"]).select(
        *columns, F.pmod(home, n_turns).cast("int").alias("t"),
        F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))).alias("b"),
    )

    def search(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "found", "score")})
        arrays = []
        for side in (asked, there):
            arrays.append(side["id"].to_numpy(np.int64))
            for c, kind in (("v", np.int64), ("d", np.float64)):
                arrays.append(np.concatenate(side[c].tolist()).astype(kind).reshape(len(side), -1 if len(side[c].iloc[0]) else 0))
        row, score, found = best_of(*arrays, k)
        return pd.DataFrame({"query_id": arrays[0][row], "found": found, "score": score})

    pairs = asked.groupBy("dim", "t", "b").cogroup(candidates.groupBy("dim", "t", "b"))
    found = pairs.applyInPandas(search, "query_id long, found long, score long")
    # Query rows with one id are answered together.
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "found")))
    merged = _best_lists(found, k, order)
    return merged.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.found").alias(id_col),
        (-F.col("one.s")).alias("score"),
    )


def _best_lists(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The best ``k`` of each query's short lists; ``k`` rows per block, cut again before the lists meet."""
    salted = found.groupBy("query_id", F.pmod(F.xxhash64("found"), F.lit(16)).alias("salt")).agg(
        F.slice(order, 1, k).alias("some")
    )
    lists = salted.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k).alias("some"))
    return lists.select("query_id", F.posexplode("some").alias("at", "one"))


def best_of(
    asked: np.ndarray, q: np.ndarray, q_table: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, score and id of the ``k`` best of a block for each query, best first.

    Candidates are taken in tiles by their greatest bound, each only for the queries that one of its bounds still
    concerns. Products are of doubles where these are exact, else of longs.
    """
    most = [float(np.abs(m).max(initial=0)) for m in (q, x)]
    kind = np.float64 if most[0] * most[1] * q.shape[1] < 2**53 else np.int64
    q, x = q.astype(kind), x.astype(kind)
    norms = [(m.astype(np.float64) ** 2).sum(1) for m in (q, x)]
    low = np.zeros((len(q), len(x)))
    for one, other in zip(q_table.T, table.T):
        # Roots and sums are rounded: the slack keeps the bounds above the true scores.
        np.maximum(low, np.abs(one[:, None] - other) - 1e-11 * (one[:, None] + other) - 1e-6, out=low)
    size = norms[0][:, None] + norms[1]
    bound = (size - low * low) / 2 + 1e-11 * size + 1
    reach = bound.max(0)
    order = np.argsort(-reach, kind="stable")
    least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    kth = np.full(len(q), least, kind)
    row, score, found = np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.int64)
    for at in range(0, len(order), TILE):
        some = order[at : at + TILE]
        if reach[some[0]] < kth.min():
            break
        who = np.flatnonzero((bound[:, some] >= kth[:, None]).any(1))
        scores = q[who] @ x[some].T
        scores[ids[some] == asked[who, None]] = least
        enough = kth[who]
        if len(some) > k:
            enough = np.maximum(enough, np.partition(scores, -k, axis=1)[:, -k])
        r, c = np.nonzero((scores >= enough[:, None]) & (scores > least))
        row = np.concatenate([row, who[r]])
        score, found = np.concatenate([score, scores[r, c]]), np.concatenate([found, ids[some[c]]])
        best = np.lexsort((found, -score, row))
        place = np.arange(len(best)) - np.searchsorted(row[best], row[best])
        best = best[place < k]
        row, score, found = row[best], score[best], found[best]
        last = place[place < k] == k - 1
        kth[row[last]] = score[last]
    return row, score.astype(np.int64), found
