"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

Signature: every element (a copy of a shingle) receives a stream of hashed darts at exponentially spaced ranks. Darts
up to a rank that suits the weight of the text are thrown; the earliest dart of each coordinate is kept, and the rank
is doubled while a coordinate is empty. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity.

Joining: texts that agree in a band meet in a bucket. No bucket is expanded into pairs: its members are checked
against one pivot, the member that meets the most others, as the origin of a family of copies does. Where a bucket
still holds several components, the members outside the pivot's are checked against all members of other components:
as single pairs in small buckets, in blocks within tasks in large ones. So no link that shares a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components
from tidemark.llm.shingles import MIX, MIX2, Shingler, cells, jaccard, mixed

WIDTH = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 4
SMALL_BUCKET = 24
BLOCK = 512


def _gaps(keys: np.ndarray, first: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of darts ``first`` to ``first + number`` of each key, and the exponential gaps before them."""
    turns = np.arange(first + 1, first + number + 1, dtype=np.uint64) * MIX2
    hashed = mixed(keys[:, None] + turns)
    return hashed, -np.log(((hashed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signature(elements: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash of a set of cells: the hash of the earliest dart in each of ``k`` coordinates."""
    keys = mixed(elements * MIX + np.uint64(1))
    limit = k * (np.log(k) + 2) / len(keys)
    while True:
        hashed, gap = _gaps(keys, 0, 1)
        live = gap[:, 0] <= limit
        darts, ranks = [hashed[live, 0]], [gap[live, 0]]
        more, at, number = keys[live], gap[live, 0], 1
        while len(more):
            width = max(1, int(limit + 3 * limit**0.5) + 1)
            hashed, gap = _gaps(more, number, width)
            arrival = at[:, None] + np.cumsum(gap, 1)
            inside = arrival <= limit
            darts.append(hashed[inside])
            ranks.append(arrival[inside])
            on = inside[:, -1]
            more, at, number = more[on], arrival[on, -1], number + width
        dart, rank = np.concatenate(darts), np.concatenate(ranks)
        place = (mixed(dart ^ MIX) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, place))
        filled, first = np.unique(place[order], return_index=True)
        if len(filled) == k:
            return dart[order][first]
        limit *= 2


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    table = sig.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64) * MIX2
    for row in range(rows):
        key = mixed(key * MIX + table[:, row])
    return key.view(np.int64)


def _shingler(width: int) -> Shingler:
    return common.kept(("shingles", width), lambda: Shingler(width))


def signed(
    documents: DataFrame, id_col: str, text_col: str, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row: ``doc_id``, ``text_key`` (of the exact text), ``word_key`` (of its words; null without any), ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(width)
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            exact, same, keys = [], [], []
            for text, words in zip(texts, shingler.word_hashes(texts)):
                exact.append(hashlib.md5((text or "").encode()).digest())
                same.append(hashlib.md5(words.tobytes()).digest() if len(words) else None)
                keys.append(bands_of(signature(cells(shingler.shingles(words)), bands * rows), bands, rows) if len(words) else [])
            yield pa.record_batch([
                batch.column(0), pa.array(exact, pa.binary()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ], ["doc_id", "text_key", "word_key", "keys"])

    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, text_key binary, word_key binary, keys array<long>")


def _checked(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, kept = _shingler(width), (None, None)
        for batch in common.slices(batches, 256):
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            found = []
            rights = shingler.word_hashes(right)
            for i, text in enumerate(left):
                if kept[0] != a[i]:
                    kept = a[i], cells(shingler.shingles(shingler.word_hashes([text])[0]))
                found.append(jaccard(kept[1], cells(shingler.shingles(rights[i]))) >= similarity)
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    one = texts.select(F.col("text_key").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("text_key").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a binary, b binary")


def _in_blocks(crowd: DataFrame, texts: DataFrame, width: int, similarity: float, block: int) -> DataFrame:
    """Links from the ``outside`` members of large buckets to members of other components.

    ``crowd`` has ``key, node, label, outside, n, m`` (members, and those outside). Members meet in blocks of about
    ``block``; a task keeps as many links as connect what it has found, never the pairs.
    """

    def run(batch_a: pd.DataFrame, batch_b: pd.DataFrame) -> pd.DataFrame:
        if not len(batch_a) or not len(batch_b):
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        shingler = _shingler(width)
        sets = [cells(shingler.shingles(w)) for x in (batch_a, batch_b) for w in shingler.word_hashes(x["text"].tolist())]
        links = joined(sets, len(batch_a), similarity, batch_a["label"].tolist(), batch_b["label"].tolist(),
                       batch_a["node"].tolist(), batch_b["node"].tolist())
        return pd.DataFrame(links, columns=["a", "b"], dtype=object)

    full = crowd.join(texts.select(F.col("text_key").alias("node"), "text"), "node")
    spread = F.xxhash64("node")
    many = F.ceil(F.col("n") / block).cast("int")
    few = F.ceil(F.col("m") / block).cast("int")
    columns = ["key", "node", "label", "text"]
    out = full.where("outside").select(
        *(F.col(c).alias(c) for c in columns), F.pmod(spread, few).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), many - 1)).alias("y"),
    )
    every = full.select(
        *(F.col(c).alias(c) for c in columns), F.pmod(spread, many).cast("int").alias("y"),
        F.explode(F.sequence(F.lit(0), few - 1)).alias("x"),
    )
    place = [F.col(c) for c in ("key", "x", "y")]
    return out.groupBy(*place).cogroup(every.groupBy(*place)).applyInPandas(run, "a binary, b binary")


def joined(sets, n: int, similarity: float, label_a, label_b, node_a, node_b) -> list[tuple[bytes, bytes]]:
    """Links between the first ``n`` sets and the rest, as many as connect their labels.

    Shared cells are counted by products of 0/1 tables, a range of cells at a time.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, len(sets) - n), np.float32)
    common_ = times[column] > 1
    numbers = np.cumsum(times > 1) - 1
    column, owner = numbers[column[common_]], owner[common_]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(numbers[-1]) + 1 if len(numbers) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        shared += table[:n] @ table[n:].T
    total = sizes[:n, None] + sizes[None, n:] - shared
    found = np.argwhere(shared >= similarity * total)
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, j in found:
        one, two = root(label_a[i]), root(label_b[j])
        if one != two:
            parent[one] = two
            links.append((node_a[i], node_b[j]))
    return links


def near_duplicates(
    documents: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small: int = SMALL_BUCKET, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, class_id, text_key``.

    Rows are in one class if a chain of links joins them: equal words, or a weighted Jaccard similarity of
    ``similarity`` or more of their shingles of ``width`` words, each shingle as often as it occurs. ``class_id`` is the
    smallest id in the class (null if all its ids are null). Texts without words (null, empty, marks only) are linked
    to nothing: each such row is a class of its own. A text of under ``width`` words is one shingle. Repeated rows are
    copies like others; other columns are not read. A pair at 0.8 shares a band but for 2 in a million.
    """
    common.ship(documents.sparkSession)
    rows_ = common.written(signed(documents, id_col, text_col, width, bands, rows), f"{folder}/signatures")
    # One node per different sequence of words: the smallest of its texts' keys.
    nodes = rows_.where("word_key IS NOT NULL").groupBy("word_key").agg(
        F.min_by("keys", "text_key").alias("keys"), F.min("text_key").alias("node")
    )
    nodes = common.written(nodes, f"{folder}/nodes")
    places = nodes.select("node", F.explode("keys").alias("key"))
    crowded = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = common.written(places.join(crowded, "key"), f"{folder}/buckets")
    reach = met.groupBy("node").agg(F.sum("n").alias("reach"))
    ranked = met.join(reach, "node")
    pivots = ranked.groupBy("key").agg(F.max_by("node", F.struct("reach", "node")).alias("pivot"))
    stars = met.join(pivots, "key").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    text_key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    texts = documents.select(text_key.alias("text_key"), F.col(text_col).alias("text"))
    wanted = reach.select(F.col("node").alias("text_key"))
    texts = texts.join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = common.written(texts, f"{folder}/texts")
    first = common.written(_checked(stars.distinct(), texts, width, similarity), f"{folder}/first-links")
    labels = components(first, f"{folder}/first")

    # Buckets that hold several components: what is outside the pivot's meets all that is in others.
    known = met.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    home = known.join(pivots.withColumnRenamed("pivot", "node"), ["key", "node"]).select("key", F.col("label").alias("home"))
    known = known.join(home, "key").withColumn("outside", F.col("label") != F.col("home"))
    mixed_ = known.groupBy("key").agg(F.count_if("outside").alias("m")).where("m > 0")
    known = common.written(known.join(mixed_, "key"), f"{folder}/mixed")
    # In a bucket with one member outside, the star has already checked it against the pivot.
    few = known.where(F.col("n") <= small)
    one = few.where("outside").select("key", F.col("node").alias("a"), F.col("label").alias("la"))
    two = few.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("outside").alias("ob"))
    pairs = one.join(two, "key").where("la <> lb AND (NOT ob OR a < b)").select("a", "b")
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(done.distinct(), ["a", "b"], "left_anti")
    second = _checked(pairs, texts, width, similarity)
    third = _in_blocks(known.where(F.col("n") > small), texts, width, similarity, block)
    links = common.written(first.union(second).union(third), f"{folder}/links")
    labels = components(links, f"{folder}/last")

    members = rows_.join(nodes.select("word_key", "node"), "word_key", "left")
    members = members.join(labels, "node", "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("label"))
    classes = members.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return members.join(classes, "label", "left").select(
        "doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "text_key"
    )
