"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

A vector x gets one more component, sqrt(M**2 - |x|**2) with M the greatest length of all; a query gets 0 there. Then
the distance of a query and a vector falls as their inner product grows, and the triangle inequality holds. A node of a
tree has a vantage point and two halves, the nearer and the farther rows, each with the least and the greatest distance
from it. A half is passed over if its least possible distance from the query, times a factor, is above the distance
of the k-th best so far. Factor one is the exact search; a greater one visits less.

Queries go down a tree together: those at a node are split by the half that is nearer to them, and the other half is
asked afterwards by those that still need it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

FACTOR = 4.0
SHARD = 8192
QUERY_BLOCK = 8192
AT_ONCE = 512  # queries that go down a tree together
LEAF = 128
SLACK = 1e-7  # of the largest distance: more than rounding can move a bound


def usable(vector: str) -> Column:
    """Whether a vector is there, is not zero, and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, folder: str, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id",
    vector_col: str = "embedding", shard: int = SHARD, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` rows found nearest to each query row: ``query_id, rank, <id>, score``, the inner product in doubles.

    Rows with null ids or unusable vectors take no part. Vectors of other lengths than the query's are no candidates;
    nor is a row with the query's id. Equal scores go to the smaller id; of repeated rows each is a candidate of its
    own, while query rows with one id are answered together, each of their vectors with candidates of its own. Other
    columns do not matter.

    Rows are dealt to shards of about ``shard`` rows by a hash of id and vector, so a vector that is very common is in
    all of them; a shard keeps one node for equal vectors. Each query first asks one shard. The k-th best there is a
    bound that it takes to all other shards, of which each returns ``k`` rows at most. A task holds a shard and a block
    of queries. The tree is built by the task that asks it: it costs about as much as a few dozen queries.
    """
    if factor < 1:
        raise ValueError("a factor below one does not relax anything")
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = common.written(
        rows.select("id", "v", "q", F.size("v").alias("dim"), norm.alias("norm"), F.xxhash64("id", "v").alias("h")),
        f"{folder}/vectors",
    )
    found = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("m"), F.max("norm").alias("most"))
    sizes = {r.dim: (-(-r.n // shard), max(1, -(-r.m // query_block)), r.most) for r in found.collect()}
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")

    def of_dim(at: int) -> Column:
        return F.create_map(*(F.lit(x) for dim, s in sizes.items() for x in (dim, s[at])))[F.col("dim")]

    home, turn = F.pmod("h", of_dim(0)).cast("int"), F.pmod("h", of_dim(1)).cast("int")
    # Named anew, so that the two sides have no column in common.
    columns = [F.col(c).alias(c) for c in ("id", "v", "dim")]
    there = rows.select(*columns, home.alias("shard"))
    asked = rows.where("q").dropDuplicates(["id", "v"]).select(*columns, home.alias("home"), turn.alias("turn"), F.lit(None).cast("double").alias("bound"))
    schema = "query_id long, dim int, found long, score double"

    def search(key: tuple, asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        return search_shard(asked, there, int(key[0]), sizes[int(key[0])][2], k, factor)

    first = asked.withColumn("shard", F.col("home")).groupBy("dim", "shard").cogroup(there.groupBy("dim", "shard"))
    first = common.written(first.applyInPandas(search, schema), f"{folder}/first")
    # Only k rows from one shard are a bound; with fewer, better ones may be anywhere.
    bound = first.groupBy(F.col("query_id").alias("id"), "dim").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bound = bound.select("id", "dim", F.when(F.col("n") >= k, F.col("least")).alias("bound"))
    others = F.array_except(F.sequence(F.lit(0), of_dim(0) - 1), F.array("home"))
    asking = asked.drop("bound").join(bound, ["id", "dim"], "left").withColumn("shard", F.explode(others))
    spread = there.withColumn("turn", F.explode(F.sequence(F.lit(0), of_dim(1) - 1)))
    rest = asking.groupBy("dim", "turn", "shard").cogroup(spread.groupBy("dim", "turn", "shard"))
    rest = common.written(rest.applyInPandas(search, schema), f"{folder}/rest")
    # k rows per query and shard; salted, so that those of many shards are cut before they meet.
    row = F.struct((-F.col("score")).alias("s"), "found")
    lists = first.unionByName(rest).groupBy("query_id", F.pmod(F.xxhash64("found"), F.lit(16)).alias("salt"))
    lists = lists.agg(F.slice(F.sort_array(F.collect_list(row)), 1, k).alias("some")).groupBy("query_id")
    lists = lists.agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k).alias("some"))
    return lists.select("query_id", F.posexplode("some").alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.found").alias(id_col),
        (-F.col("one.s")).alias("score"),
    )


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: int = -1
    near: tuple[Node, float, float] | None = None
    far: tuple[Node, float, float] | None = None


class Tree:
    """A vantage-point tree over the different vectors of a shard."""

    def __init__(self, x: np.ndarray, most: float, leaf: int = LEAF) -> None:
        self.x, self.most, self.leaf = x, most, leaf
        self.extra = np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray) -> Node:
        if len(rows) <= self.leaf:
            return Node(rows=rows)
        # The row farthest from the first is at the edge, from where distances differ most.
        point = rows[np.argmax(self._from(rows[0], rows))]
        distance = self._from(point, rows)
        order = np.argsort(distance, kind="stable")
        halves = []
        for part in np.array_split(order, 2):
            halves.append((self._grow(rows[part]), float(distance[part[0]]), float(distance[part[-1]])))
        return Node(point=int(point), near=halves[0], far=halves[1])

    def _from(self, point: int, rows: np.ndarray) -> np.ndarray:
        inner = self.x[rows] @ self.x[point] + self.extra[rows] * self.extra[point]
        return np.sqrt(np.maximum(2 * (self.most * self.most - inner), 0))


class Asking:
    """Queries with the best rows that they have found in a tree so far."""

    def __init__(self, tree: Tree, queries: np.ndarray, bound: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.queries, self.k, self.factor = tree, queries, k, factor
        self.square = (queries * queries).sum(1) + tree.most * tree.most
        self.slack = SLACK * (np.sqrt(self.square) + tree.most)
        self.scores = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1)
        self.bound = bound
        self.visited = 0

    def reach(self, who: np.ndarray) -> np.ndarray:
        """The distance of the k-th best so far, over the factor: nothing farther is of use."""
        kth = np.maximum(self.scores[who, -1], self.bound[who])
        return np.sqrt(np.maximum(self.square[who] - 2 * kth, 0)) / self.factor + self.slack[who]

    def visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.rows is not None:
            self._leaf(node.rows, who)
            return
        inner = self.queries[who] @ self.tree.x[node.point]
        distance = np.sqrt(np.maximum(self.square[who] - 2 * inner, 0))
        least = [np.maximum(np.maximum(distance - hi, lo - distance), 0) for _, lo, hi in (node.near, node.far)]
        middle = (node.near[2] + node.far[1]) / 2
        inside = distance <= middle
        for first, second, group in ((0, 1, inside), (1, 0, ~inside)):
            halves = (node.near, node.far)
            for half in (first, second):
                mine = np.flatnonzero(group)
                mine = mine[least[half][mine] <= self.reach(who[mine])]
                self.visit(halves[half][0], who[mine])

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        self.visited += len(rows) * len(who)
        scores = self.queries[who] @ self.tree.x[rows].T
        better = np.flatnonzero((scores > self.scores[who, -1][:, None]).any(1))
        who, scores = who[better], scores[better]
        merged = np.concatenate([self.scores[who], scores], 1)
        best = np.argpartition(-merged, self.k - 1, 1)[:, : self.k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(merged, best, 1), 1, "stable"), 1)
        known = np.concatenate([self.rows[who], np.broadcast_to(rows, scores.shape)], 1)
        self.scores[who] = np.take_along_axis(merged, best, 1)
        self.rows[who] = np.take_along_axis(known, best, 1)


def search_shard(asked: pd.DataFrame, there: pd.DataFrame, dim: int, most: float, k: int, factor: float) -> pd.DataFrame:
    """``query_id, dim, found, score``: up to ``k`` rows of a shard for each query, with scores summed in one order."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(asked) and len(there):
        ids = there["id"].to_numpy(np.int64)
        x = np.array(there["v"].tolist(), np.float64).reshape(len(ids), dim)
        # Equal vectors are one; of their ids the k + 1 least are enough, of which one may be the query's own.
        _, first, which = np.unique(x.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        x, order = x[first], np.lexsort((ids, which))
        starts = np.searchsorted(which[order], np.arange(len(first) + 1))
        same = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(starts, starts[1:])]
        # One more row, as a query may find itself, and some for scores that rounding has put in another order.
        tree, spare = Tree(x, most), k + 1 + 8
        queries = np.array(asked["v"].tolist(), np.float64).reshape(len(asked), dim)
        bound = asked["bound"].fillna(-np.inf).to_numpy(np.float64)
        who = asked["id"].to_numpy(np.int64)
        for at in range(0, len(queries), AT_ONCE):
            some = queries[at : at + AT_ONCE]
            asking = Asking(tree, some, bound[at : at + AT_ONCE], spare, factor)
            asking.visit(tree.root, np.arange(len(some)))
            for query, own, rows in zip(some, who[at : at + AT_ONCE], asking.rows):
                rows = rows[rows >= 0]
                exact = (x[rows] * query).sum(1)
                found = np.concatenate([same[r] for r in rows]) if len(rows) else np.empty(0, np.int64)
                score = np.repeat(exact, [len(same[r]) for r in rows])
                keep = found != own
                found, score = found[keep], score[keep]
                best = np.lexsort((found, -score))[:k]
                out.append((np.full(len(best), own), found[best], score[best]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
    return pd.DataFrame({
        "query_id": columns[0], "dim": np.full(len(columns[0]), dim, np.int32), "found": columns[1], "score": columns[2],
    })
