"""Divergence of the sources of each language: how far the words of one are from those of another.

Documents become counts of terms per (language, source), and the terms kept for a language an index by term: a term
with the sources that have it. The rows of a block of that index are multiplied as Gustavson does it: each source
scatters its terms through the index into one dense accumulator over its peers, so a pair of postings is never a row.
The scatter only visits terms that both sources have. What a term adds where one source or both lack it depends on the
other's count alone, so it is summed over different counts; the scatter corrects these baselines. Blocks are sums over
their own terms, and add up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SCALE = 1_000_000_000
POSTINGS = 100_000  # of a block of the index
HELD_TERMS = 400_000  # that a task counts before it passes its counts on
PIECE = 1 << 20  # bytes of a text that are taken at once
GATHER = 1 << 18  # postings that are scattered at once
# A-Z become a-z, a-z and bytes of other characters stay, the rest separates terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in parts, so that a long text is not a list of terms as a whole."""
    text = text.translate(LETTERS)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and the documents with the term; null texts and groups are ''."""
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    schema = "lang string, source string, term string, n long, docs long"

    def part(groups: dict) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            columns = [
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in common.slices(batches, 256):
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                seen: set[bytes] = set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                held += len(n)
                if held > HELD_TERMS:
                    yield from part(groups)
                    groups, held = {}, 0
        yield from part(groups)

    found = rows.mapInArrow(count, schema)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exactly, by long division with three digits at a time."""
    rest, out = np.broadcast_arrays(n + 1, total)[0].copy(), 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q)."""
    return (p - q) ** 2 // q


def compare_sources(
    documents: DataFrame, folder: str, least_docs: int = 3, top: int = 200, postings: int = POSTINGS
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``documents``.

    Part ``pair`` has a row for each other source of the language, with the divergence from it over the language's kept
    terms, part ``term`` one for each of the ``top`` terms of the source that exceed the language most. A term is kept
    if ``least_docs`` documents of its language have it; each row is a document, repeated ones too. Null text, lang and
    source are ''. A source without terms, as of null or empty texts, has all counts zero; a language without kept
    terms has the value 0 for its pairs; a source alone in its language has none. Equal values are ranked by the
    item's UTF-8. Other columns do not matter, whatever their names. Numbers are exact while a language's kept terms
    occur fewer than 9e15 times.

    A task holds one block of terms of a language, about ``postings`` postings, and one row per source of it. The
    result has a row per pair of sources, by its definition.
    """
    spark = documents.sparkSession
    common.ship(spark)
    with common.shuffles_dropped(spark):
        terms = term_counts(documents).groupBy("lang", "term").agg(
            F.collect_list(F.struct("source", "n")).alias("by_source"), F.sum("docs").alias("docs"), F.sum("n").alias("n")
        )
        index = common.written(terms.where(F.col("docs") >= least_docs).drop("docs"), f"{folder}/index", "zstd")
    languages = index.groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("n").alias("lang_total"),
        F.ceil(F.sum(F.size("by_source")) / postings).cast("int").alias("blocks"),
    )
    totals = index.select("lang", F.inline("by_source")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seen = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    groups = seen.distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = common.written(groups.na.fill({"total": 0, "kept": 0, "lang_total": 0, "blocks": 1}), f"{folder}/groups")
    peers = groups.select(
        "lang", "source", "total", "kept", "lang_total",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    blocks = index.join(groups.groupBy("lang").agg(F.max("blocks").alias("blocks")), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "n",
        F.transform("by_source", lambda x: x["source"]).alias("sources"),
        F.transform("by_source", lambda x: x["n"]).alias("counts"),
    )

    def multiply(key: tuple, peers: pa.Table, block: pa.Table) -> pa.Table:
        return block_sums(key[0].as_py(), peers, block, top)

    pairs = peers.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block"))
    sums = pairs.applyInArrow(multiply, "lang string, source string, part string, item string, value long")
    sums = common.written(sums, f"{folder}/sums")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = sums.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    term = sums.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term)


def block_sums(lang: str, peers: pa.Table, block: pa.Table, top: int) -> pa.Table:
    """The divergence over a block's terms of each source from each other one, and each source's ``top`` terms in it."""
    names = peers["source"].to_pylist()
    if not names:  # no block is without sources
        raise ValueError(f"no sources for a block of {lang!r}")
    totals = peers["total"].to_numpy() + peers["kept"].to_numpy()
    lang_total = int(peers["lang_total"][0].as_py() + peers["kept"][0].as_py())
    n_terms, n_peers = block.num_rows, len(names)
    acc = np.zeros((n_peers, n_peers), np.int64)
    best: list[tuple[int, np.ndarray, np.ndarray]] = []
    terms: list[str] = block["term"].to_pylist()
    if n_terms:
        sizes = pc.list_value_length(block["sources"]).to_numpy().astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        peer = pc.index_in(pc.list_flatten(block["sources"]), peers["source"].combine_chunks()).to_numpy().astype(np.int64)
        n = pc.list_flatten(block["counts"]).to_numpy().astype(np.int64)
        term = np.repeat(np.arange(n_terms), sizes)
        p = share(n, totals[peer])
        zero = share(np.zeros(n_peers, np.int64), totals)
        whole = share(block["n"].to_numpy().astype(np.int64), np.int64(lang_total))
        place = np.empty(n_terms, np.int64)  # of a term among the block's, by UTF-8
        place[np.argsort(np.array([t.encode() for t in terms], object), kind="stable")] = np.arange(n_terms)
        by_source = np.argsort(peer, kind="stable")
        ends = np.searchsorted(peer[by_source], np.arange(n_peers + 1))
        own = np.diff(ends)
        acc += (n_terms - own[:, None] - own[None, :]) * excess(zero[:, None], zero[None, :])
        for a in range(n_peers):
            mine = by_source[ends[a] : ends[a + 1]]
            values, times = np.unique(p[mine], return_counts=True)
            for at in range(0, len(values), 1 + GATHER // n_peers):
                some = slice(at, at + 1 + GATHER // n_peers)
                acc[a] += times[some] @ excess(values[some, None], zero[None, :])
                acc[:, a] += times[some] @ excess(zero[None, :], values[some, None])
            _scatter(acc[a], a, mine, peer, term, p, zero, starts, sizes)
            found = mine[p[mine] > whole[term[mine]]]
            value = excess(p[found], whole[term[found]])
            order = np.lexsort((place[term[found]], -value))[:top]
            best.append((a, term[found][order], value[order]))
    rows, columns = np.nonzero(~np.eye(n_peers, dtype=bool))
    source = np.concatenate([rows, *(np.full(len(t), a) for a, t, _ in best)])
    names_of = pa.array(names, pa.string())
    items = [names_of.take(pa.array(columns)), *(pa.array([terms[i] for i in t], pa.string()) for _, t, _ in best)]
    value = np.concatenate([acc[rows, columns], *(v for _, _, v in best)])
    part = ["pair"] * len(rows) + ["term"] * (len(source) - len(rows))
    return pa.table({
        "lang": pa.array([lang] * len(source), pa.string()), "source": names_of.take(pa.array(source)),
        "part": pa.array(part, pa.string()), "item": pa.concat_arrays(items), "value": pa.array(value, pa.int64()),
    })


def _scatter(row, a, mine, peer, term, p, zero, starts, sizes) -> None:
    """Add to a source's row what its terms have in common with those of its peers, less both baselines."""
    reach = np.cumsum(sizes[term[mine]])
    at = 0
    while at < len(mine):
        base = reach[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(reach, base + GATHER, "right")))
        some = mine[at:end]
        length = sizes[term[some]]
        there = np.repeat(starts[term[some]] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        q, other, here = p[there], peer[there], np.repeat(p[some], length)
        gain = excess(here, q) - excess(here, zero[other]) - excess(zero[a], q) + excess(zero[a], zero[other])
        np.add.at(row, other, gain)
        at = end
