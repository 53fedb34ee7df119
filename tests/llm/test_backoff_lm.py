"""The language model against a plain one in dictionaries, and its probabilities against one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import backoff_lm, common, queries
from tidemark.llm.backoff_lm import CUT

SF = "/root/testdata/sf0.001"
END = None


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text)), END]


class Plain:
    """Katz pairs with dictionaries."""

    def __init__(self, texts):
        self.one, self.two, self.texts = Counter(), Counter(), len(texts)
        for text in texts:
            words = split(text)
            self.one.update(words)
            self.two.update(zip(["start", *map(lambda w: (w,), words)], words))
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d1 = backoff_lm.discounts(self.times(self.one))
        self.d2 = backoff_lm.pair_discounts(self.times(self.two))
        self.unknown = 1 - sum(self.kept(c, self.d1) for c in self.one.values()) / self.n if self.d1 is not None else 0
        if self.unknown <= 0:
            self.d1, self.unknown = None, 0.5 / (self.n + 0.5 * (self.v + 1))
        self.after = defaultdict(dict)
        for (h, w), c in self.two.items():
            self.after[h][w] = c

    def times(self, counts):
        by = Counter(counts.values())
        return [by[r] for r in range(1, CUT + 2)]

    def kept(self, c, d):
        return c * (d[c] if c <= CUT else 1)

    def single(self, w):
        if w not in self.one:
            return self.unknown
        return self.kept(self.one[w], self.d1) / self.n if self.d1 is not None else (self.one[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def pair(self, h, w):
        total = self.texts if h == "start" else self.one[h[0]]
        if not total:
            return self.single(w)
        seen = self.after[h]
        under = total + all(c > CUT for c in seen.values())
        if w in seen:
            return self.kept(seen[w], self.d2) / under
        left = 1 - sum(self.kept(c, self.d2) for c in seen.values()) / under
        return left / (1 - sum(map(self.single, seen))) * self.single(w)

    def score(self, text):
        words = split(text)
        return sum(math.log10(self.pair(h, w)) for h, w in zip(["start", *((w,) for w in words)], words))

    def row(self, text):
        words = split(text)
        base = sum(math.log10((self.one[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in words)
        return len(words), sum(w in self.one for w in words), self.n, pytest.approx(base), pytest.approx(self.score(text))


def check(found, rows, held):
    model = Plain([t for i, t in rows if not held(i)])
    want = sorted(((i, held(i), *model.row(t)) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
    return model


def test_query_equals_plain_model(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(queries.op3_backoff_lm(spark, SF), rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_and_frequent_words(spark, seed):
    rng = random.Random(seed)
    words = ["The", "of", *(f"w{i}" for i in range(60)), "É"]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(1, 63)]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    folder = common.work_dir(spark, "t")
    found = backoff_lm.score(df, F.col("doc_id") % 4 == 0, folder, chunk_tokens=300, bucket_pairs=100)
    model = check(found, rows, lambda i: i % 4 == 0)
    stored = spark.read.parquet(f"{folder}/answers").where("kind = 'pairs'").collect()
    assert sum(len(r.b) // 4 for r in stored) == len(model.two)


def test_probabilities_sum_to_one():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "c", *(f"w{i}" for i in range(80))]) for _ in range(rng.randint(1, 30))) for _ in range(100)]
    texts += ["x y"] * 9  # after x and y comes one thing each, over the cut
    model = Plain(texts)
    for h in ["start", *((w,) for w in model.one if w), ("never",)]:
        assert sum(model.pair(h, w) for w in model.one) + model.pair(h, "unknown") == pytest.approx(1)
    assert sum(map(model.single, model.one)) + model.unknown == pytest.approx(1)


def test_edges(spark, edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    held = F.coalesce(F.col("doc_id") == 4, F.lit(False))
    check(backoff_lm.score(edges, held, common.work_dir(spark, "t")), rows, lambda i: i == 4)
    assert backoff_lm.score(edges.limit(0), held, common.work_dir(spark, "t")).count() == 0
    none = backoff_lm.score(edges, F.lit(True), common.work_dir(spark, "t")).collect()
    assert len(none) == len(rows) and all(r.score == r.base_score == r.n_known == r.train_tokens == 0 for r in none)
