"""Katz backoff language model of pairs of words, trained and evaluated in blocks of documents.

Words get numbers by falling frequency, so a number gives its count through a short table. Each block of documents
sends its different pairs, with their training counts, to the bucket of the first word (pairs of very frequent first
words are spread). A bucket adds up the counts of all blocks, stores its part of the pair table and answers every
block: the count of each pair asked for, and for each first word what its backoff weight needs. The block then scores
its texts: a pair that was seen has its discounted share, any other the backoff weight of its first word times the
probability of its second word.

Probabilities are exactly normalised over the training words and one class of unknown words: for each history the
discounted shares and the backoff weight times the words that did not follow it sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.token_ids import _Index

CUT = 5  # counts up to this are discounted
CHUNK_TOKENS = 1_000_000
BUCKET_PAIRS = 1_000_000
END = 1  # stands for the end of a text among the words' hashes
WORD_LIMIT = 400_000


def planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers by planes: all first bytes, then all second bytes and so on, which compresses better."""
    data = np.ascontiguousarray(values.astype(kind))
    return data.view("u1").reshape(-1, data.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, "u1").reshape(size, len(data) // size).T.copy().view(kind).ravel()


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case; the end of the text is not listed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def discounts(times: list[int]) -> np.ndarray | None:
    """Good-Turing ratios for counts 0 to ``CUT`` from the numbers of types with counts 1 to ``CUT + 1``.

    The cut is lowered where a ratio is not between 0 and 1, as with few types; None if no cut works.
    """
    n = [0, *times]
    for cut in range(CUT, 0, -1):
        if any(n[r] == 0 for r in range(1, cut + 2)):
            continue
        common_ = (cut + 1) * n[cut + 1] / n[1]
        if common_ >= 1:
            continue
        ratios = [((r + 1) * n[r + 1] / (n[r] * r) - common_) / (1 - common_) for r in range(1, cut + 1)]
        if all(0 < d < 1 for d in ratios):
            return np.array([1.0, *ratios, *[1.0] * (CUT - cut)])
    return None


@dataclass
class Unigrams:
    """Counts by word number and the probabilities of single words.

    ``first[i]`` is the first number whose count is ``value[i]`` (falling). Without usable Good-Turing ratios, words
    have add-half probabilities.
    """

    first: np.ndarray
    value: np.ndarray
    texts: int

    def __post_init__(self):
        self.size = int(self.first[-1]) if len(self.first) else 0  # words with a number; the last entry is a bound
        seen = self.value[:-1] > 0
        times = np.diff(self.first)[seen] if len(self.first) else np.zeros(0, np.int64)
        counts = self.value[:-1][seen]
        self.tokens, self.types = int((times * counts).sum()), int(times.sum())
        by_count = dict(zip(counts.tolist(), times.tolist()))
        self.ratio = discounts([by_count.get(r, 0) for r in range(1, CUT + 2)])
        if self.ratio is not None:
            kept = float(sum(n * c * self._ratio(c) for c, n in by_count.items()))
            self.unknown = 1 - kept / self.tokens
        if self.ratio is None or self.unknown <= 0:
            self.ratio, self.unknown = None, 0.5 / (self.tokens + 0.5 * (self.types + 1))

    def _ratio(self, count: int) -> float:
        return float(self.ratio[count]) if count <= CUT else 1.0

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of words; the number after the last stands for the start of a text."""
        at = np.searchsorted(self.first, numbers, side="right") - 1
        return np.where(numbers == self.size, self.texts, self.value[at])

    def probability(self, count: np.ndarray) -> np.ndarray:
        """Of words with these counts; 0 is the class of unknown words."""
        if self.ratio is None:
            return (count + 0.5) / (self.tokens + 0.5 * (self.types + 1))
        shares = count * np.where(count <= CUT, self.ratio[np.minimum(count, CUT)], 1.0) / max(self.tokens, 1)
        return np.where(count > 0, shares, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-half probabilities."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def chunks(documents: DataFrame, held: Column, id_col: str, text_col: str, chunk_tokens: int) -> DataFrame:
    """Blocks of documents: words (hashes, by falling frequency), token places, and the documents' ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = _Index(), np.zeros(0, np.uint64)
        part, number = TaskContext.get().partitionId(), 0
        ids, held_, lengths, flat, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(flat)
            words, tokens, times = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            train = np.repeat(~np.array(held_), lengths)
            counts = np.bincount(tokens, train, len(words)).astype("<u4")[order]
            row = {
                "chunk": (part << 24) + number, "words": words[order].astype("<u8").tobytes(), "counts": counts.tobytes(),
                "tokens": planes(place[tokens], "<u4"), "ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
                "named": np.array([i is not None for i in ids], "u1").tobytes(), "held": held_, "lengths": lengths,
            }
            return pa.RecordBatch.from_pylist([row], schema=CHUNKS)

        for batch in common.slices(batches):
            if len(index) > WORD_LIMIT:
                index, hashes = _Index(), np.zeros(0, np.uint64)
            places = []
            for text in batch.column(1).to_pylist():
                words = tokens_of(text)
                places.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            new, index.new = index.new, []
            # A hash equal to the end's is as unlikely as two words with one hash.
            hashes = np.concatenate([hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
            for key, out, place in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), places):
                ids.append(key)
                held_.append(bool(out))
                lengths.append(len(place) + 1)
                flat += [hashes[place], np.array([END], np.uint64)]
                size += len(place) + 1
                if size >= chunk_tokens:
                    yield flush()
                    ids, held_, lengths, flat, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield flush()

    rows = documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), held.alias("h"))
    return rows.mapInArrow(
        run,
        "chunk long, words binary, counts binary, tokens binary, ids binary, named binary, held array<boolean>, "
        "lengths array<long>",
    )


CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()),
    ("ids", pa.binary()), ("named", pa.binary()), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
])


def _words(parts: DataFrame) -> DataFrame:
    """The words of each block: ``chunk, place, word, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            words = np.frombuffer(batch.column(1)[0].as_buffer(), "<i8")
            counts = np.frombuffer(batch.column(2)[0].as_buffer(), "<u4").astype(np.int64)
            for at in range(0, len(words), 50_000):
                some = slice(at, at + 50_000)
                n = len(words[some])
                yield pa.record_batch([
                    pa.array(np.full(n, batch.column(0)[0].as_py())), pa.array(np.arange(at, at + n, dtype=np.int32)),
                    pa.array(words[some]), pa.array(counts[some]),
                ], ["chunk", "place", "word", "n"])

    return parts.select("chunk", "words", "counts").mapInArrow(run, "chunk long, place int, word long, n long")


def numbered_words(words: DataFrame, folder: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The vocabulary ``word, number, c`` by falling count, and the table of counts (first number, count).

    The table has one line per different count, at most the square root of twice the tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
                ["word", "c", "part", "at"],
            )
            at += n

    total = words.groupBy("word").agg(F.sum("n").alias("c"))
    ordered = total.repartitionByRange(F.desc("c"), "word").sortWithinPartitions(F.desc("c"), "word")
    vocabulary = common.written(ordered.mapInArrow(run, "word long, c long, part int, at long"), f"{folder}/unigrams")
    sizes = vocabulary.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per task
    starts, at = [], 0
    for r in sizes:
        starts.append((r.part, at))
        at += r.n
    starts = words.sparkSession.createDataFrame(starts, "part int, start long")
    vocabulary = vocabulary.join(F.broadcast(starts), "part").select("word", (F.col("start") + F.col("at")).alias("number"), "c")
    table = vocabulary.groupBy("c").agg(F.min("number").alias("first")).orderBy(F.desc("c")).toPandas()
    return vocabulary, np.append(table["first"].to_numpy(np.int64), at), np.append(table["c"].to_numpy(np.int64), 0)


def _pairs(numbers: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, start: int, hot: int, buckets: int):
    """A block's different pairs by bucket, first and second word; their place for each token; bucket bounds."""
    second = numbers[tokens]
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.cumsum(lengths) - lengths] = start
    if start < 1 << 31:
        key, inverse = np.unique(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), return_inverse=True)
        first, second = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    else:
        (first, second), inverse = np.unique(np.stack([first, second]), axis=1, return_inverse=True)
    spread = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    frequent = first < hot
    spread[frequent] += second[frequent].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    bucket = ((spread ^ (spread >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")  # pairs stay in order within a bucket
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return first[order], second[order], place[inverse.ravel()], bounds


def _runs(first: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)


STATS = CUT + 2  # per first word: seconds with counts 1 to CUT, tokens of higher counts, their words' probabilities


def _sums(first: np.ndarray, second: np.ndarray, count: np.ndarray, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """First words with training pairs, and their statistics."""
    seen = count > 0
    first, second, count = first[seen], second[seen], count[seen]
    at = _runs(first)
    columns = [*((count == r) for r in range(1, CUT + 1)), np.where(count > CUT, count, 0)]
    columns.append(unigrams.probability(unigrams.count(second)))
    stats = np.stack([np.add.reduceat(c.astype(np.float64), at) for c in columns], 1) if len(at) else np.zeros((0, STATS))
    return first[at], stats


def answered(
    parts: DataFrame, numbers: DataFrame, unigrams: Unigrams, hot: int, buckets: int
) -> DataFrame:
    """Rows of all buckets: answers to blocks, the pair table, statistics of frequent first words, counts of counts."""
    wide = "<u4" if unigrams.size < 1 << 31 else "<u8"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            chunk, places, tokens, lengths, held = _chunk(batch)
            first, second, place, bounds = _pairs(places, tokens, lengths, unigrams.size, hot, buckets)
            train = np.repeat(~held, lengths)
            count = np.bincount(place, train, len(first))
            rows = []
            for b in range(buckets):
                some = slice(bounds[b], bounds[b + 1])
                if bounds[b] == bounds[b + 1]:
                    continue
                at = _runs(first[some])
                rows.append({
                    "bucket": b, "chunk": chunk, "firsts": planes(first[some][at], wide),
                    "sizes": planes(np.diff(np.append(at, len(first[some]))), "<u4"),
                    "seconds": planes(second[some], wide), "counts": planes(count[some], "<u4"),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=ASKED)

    def answer(key, asked: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        for r in asked.itertuples():
            first = np.repeat(from_planes(r.firsts, wide), from_planes(r.sizes, "<u4")).astype(np.int64)
            blocks.append((first, from_planes(r.seconds, wide).astype(np.int64), from_planes(r.counts, "<u4")))
        first, second, count = (np.concatenate(c) for c in zip(*blocks))
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        new = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
        at = np.flatnonzero(new)
        total = np.add.reduceat(count[order].astype(np.int64), at)
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        f, s = f[at], s[at]
        words, stats = _sums(f, s, total, unigrams)
        often = words < hot
        out = [(*_kind("frequent"), words[often].astype("<i8").tobytes(), stats[often].tobytes())]
        times = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        out.append((*_kind("times"), times.astype("<i8").tobytes(), b""))
        seen = total > 0
        out.append((*_kind("pairs"), planes(np.stack([f[seen], s[seen]]).ravel(), wide), planes(total[seen], "<u4")))
        start = 0
        for (mine, _, _), chunk in zip(blocks, asked["chunk"]):
            got = total[pair[start : start + len(mine)]]
            start += len(mine)
            asked_words = mine[_runs(mine)]
            at = np.searchsorted(words, asked_words)
            known = np.zeros((len(asked_words), STATS))
            hit = (at < len(words)) & (words[np.minimum(at, max(len(words) - 1, 0))] == asked_words) if len(words) else at < 0
            known[hit] = stats[at[hit]]
            known[asked_words < hot] = 0  # those come from all buckets
            sums = planes(known[:, :-1].T.ravel(), "<u4") + planes(known[:, -1], "<f8")
            out.append(("answers", int(chunk), planes(got, "<u4"), sums))
        frame = pd.DataFrame(out, columns=["kind", "chunk", "a", "b"])
        frame["bucket"] = key[0]
        return frame[["kind", "bucket", "chunk", "a", "b"]]

    joined = parts.drop("words", "counts", "ids", "named").join(numbers, "chunk")
    asked = joined.select("chunk", "numbers", "tokens", "lengths", "held").mapInArrow(
        ask, "bucket int, chunk long, firsts binary, sizes binary, seconds binary, counts binary"
    )
    return asked.groupBy("bucket").applyInPandas(answer, "kind string, bucket int, chunk long, a binary, b binary")


ASKED = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int64()), ("firsts", pa.binary()), ("sizes", pa.binary()),
    ("seconds", pa.binary()), ("counts", pa.binary()),
])


def _kind(name: str) -> tuple[str, int]:
    return name, -1


def _chunk(batch: pa.RecordBatch):
    """A block's number, word numbers by place, tokens, lengths and held-out marks."""
    row = {name: batch.column(name)[0] for name in batch.schema.names}
    return (
        row["chunk"].as_py(), from_planes(row["numbers"].as_py(), "<i8"), from_planes(row["tokens"].as_py(), "<u4"),
        np.array(row["lengths"].as_py(), np.int64), np.array(row["held"].as_py(), bool),
    )


def weights(stats: np.ndarray, history: np.ndarray, ratio: np.ndarray, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight and denominator of histories with these statistics and counts.

    A history whose pairs all have counts over the cut has nothing discounted; its denominator is one higher, which
    leaves that share for other words. A history without training pairs leaves all to single words.
    """
    kept = stats[:, :CUT] @ (np.arange(1, CUT + 1) * ratio[1:]) + stats[:, CUT]
    whole = kept >= history * (1 - 1e-12)
    under = history + whole
    left = 1 - kept / np.maximum(under, 1)
    free = np.maximum(1 - stats[:, CUT + 1], unigrams.unknown)
    return np.where(history > 0, left / free, 1.0), np.maximum(under, 1)


def pair_discounts(times: list[int]) -> np.ndarray:
    """Good-Turing ratios of pairs; counts less a half, where there are none to be had."""
    found = discounts(times)
    return found if found is not None else np.array([1.0, *((r - 0.5) / r for r in range(1, CUT + 1))])


def score(
    documents: DataFrame, held_out: Column, folder: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_tokens: int = CHUNK_TOKENS, bucket_pairs: int = BUCKET_PAIRS,
) -> DataFrame:
    """Every row's ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from all rows where ``held_out`` is false and scores all. Tokens are the words and the end of each text
    (null as empty). ``score`` is log10 of the model's probability of the text from its start; ``base_score`` that of
    single words with half added to each count. Without training rows all words are unknown and scores 0. Repeated
    rows count and are scored each; other columns are not read. Words are told apart by 64-bit hashes.

    ``folder`` keeps the model: ``unigrams`` and ``answers/kind=pairs`` (first and second words' numbers, counts; as
    planes of unsigned 32-bit integers, numbers of 64 bits for 2**31 words or more).
    Counts of counts and the statistics of frequent first words, fewer than four per bucket, go to the driver.
    """
    spark = documents.sparkSession
    common.ship(spark)
    with common.shuffles_dropped(spark):
        parts = common.written(chunks(documents, held_out, id_col, text_col, chunk_tokens), f"{folder}/chunks", "zstd")
        words = _words(parts)
        vocabulary, first, value = numbered_words(words, folder)
        spread = F.expr("aggregate(zip_with(held, lengths, (h, n) -> int(NOT h)), 0, (a, x) -> a + x)")
        trained = parts.select(spread.alias("n")).agg(F.sum("n")).first()[0] or 0
        unigrams = Unigrams(first, value, trained)
        total = int(parts.select(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n")).agg(F.sum("n")).first()[0] or 0)
        buckets = max(8, -(-total // bucket_pairs))
        # Words with numbers below this hold over a quarter of a bucket's even share of all histories.
        hot = int(unigrams.first[int((unigrams.value > unigrams.tokens / (4 * buckets)).sum())]) if unigrams.tokens else 0

        def local(key, rows: pd.DataFrame) -> pd.DataFrame:
            found = rows.sort_values("place")["number"].to_numpy()
            return pd.DataFrame([(key[0], planes(found, "<i8"))], columns=["chunk", "numbers"])

        numbers = words.select("chunk", "place", "word").join(vocabulary.select("word", "number"), "word")
        numbers = numbers.groupBy("chunk").applyInPandas(local, "chunk long, numbers binary")
        numbers = common.written(numbers, f"{folder}/numbers")
        found = answered(parts, numbers, unigrams, hot, buckets)
        found.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/answers")
    found = spark.read.schema("bucket int, chunk long, a binary, b binary, kind string").parquet(f"{folder}/answers")
    times = [np.frombuffer(r.a, "<i8") for r in found.where("kind = 'times'").select("a").collect()]
    ratio = pair_discounts([int(x) for x in np.sum(times, 0)] if times else [0] * (CUT + 1))
    often = _frequent(found, hot)
    state = spark.sparkContext.broadcast((unigrams, ratio, often))

    def run(key, part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        unigrams, ratio, often = state.value
        row = part.iloc[0]
        tokens = from_planes(row["tokens"], "<u4")
        lengths = np.array(row["lengths"], np.int64)
        places = from_planes(row["numbers"], "<i8")
        one, two, place, bounds = _pairs(places, tokens, lengths, unigrams.size, hot, buckets)
        count = np.zeros(len(one), np.int64)
        weight, under = np.ones(len(one)), np.ones(len(one))
        for r in answers.itertuples():
            some = slice(bounds[r.bucket], bounds[r.bucket + 1])
            count[some] = from_planes(r.a, "<u4")
            at = _runs(one[some])
            words = one[some][at]
            cut = 4 * (STATS - 1) * len(words)
            stats = np.column_stack([from_planes(r.b[:cut], "<u4").reshape(STATS - 1, -1).T, from_planes(r.b[cut:], "<f8")])
            frequent = words < hot
            if len(often):
                stats[frequent] = often[words[frequent]]
            back, below = weights(stats, unigrams.count(words), ratio, unigrams)
            size = np.diff(np.append(at, len(one[some])))
            weight[some], under[some] = np.repeat(back, size), np.repeat(below, size)
        single = unigrams.count(two)
        share = count * np.where(count <= CUT, ratio[np.minimum(count, CUT)], 1.0) / under
        value = np.log10(np.where(count > 0, share, weight * unigrams.probability(single)))
        starts = np.cumsum(lengths) - lengths
        ids = pd.arrays.IntegerArray(np.frombuffer(row["ids"], "<i8").copy(), np.frombuffer(row["named"], "u1") == 0)
        return pd.DataFrame({
            "doc_id": ids,
            "held_out": np.array(row["held"], bool), "n_tokens": lengths,
            "n_known": np.add.reduceat((single > 0)[place].astype(np.int64), starts),
            "train_tokens": unigrams.tokens, "base_score": np.add.reduceat(unigrams.base(single)[place], starts),
            "score": np.add.reduceat(value[place], starts),
        })

    ready = parts.drop("words", "counts").join(numbers.withColumnRenamed("chunk", "c"), F.col("chunk") == F.col("c")).drop("c")
    answers = found.where("kind = 'answers'").select("bucket", "chunk", "a", "b")
    both = ready.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _frequent(found: DataFrame, hot: int) -> np.ndarray:
    """Statistics of the frequent first words, added over buckets; row by number."""
    table = np.zeros((hot, STATS))
    for r in found.where("kind = 'frequent'").select("a", "b").toLocalIterator():
        words = np.frombuffer(r.a, "<i8")
        table[words] += np.frombuffer(r.b, "<f8").reshape(-1, STATS)
    return table
