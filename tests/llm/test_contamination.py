"""Leaks against edit distances to all passages."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, contamination, queries
from tidemark.llm.contamination import Finder, myers, normal, pieces

SF = "/root/testdata/sf0.01"


def passage_distance(item, text):
    """Least edit distance of an item to any passage, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        got = myers(item, text, len(item))
        assert got[0] == passage_distance(item, text)
        assert passage_distance(item, text[: got[1]]) == got[0]


def test_finder_equals_brute_force():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(20, 80))).strip() for _ in range(6)]
    finder = Finder(list(enumerate(base)), 0.1)
    for _ in range(200):
        item = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        text = "".join(rng.choice("abcde ") for _ in range(30)) + "".join(item) + "tail"
        want = {i: passage_distance(t, text) for i, t in enumerate(base)}
        found = finder.find(text)
        assert {i: d for i, d, _, _ in found} == {i: d for i, d in want.items() if d <= int(len(base[i]) * 0.1)}
        for i, d, a, b in found:
            assert passage_distance(base[i], text[a:b]) == d and passage_distance(text[a:b], base[i]) <= d


def test_pieces_cover_items():
    for n in range(1, 200):
        parts = pieces("x" * n, 0.05)
        assert len(parts) == int(n * 0.05) + 1 and sum(len(p) for _, p in parts) == n


def test_query_finds_whole_items(spark):
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op8_contamination(spark, SF).collect()}
    items = [(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, normal(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    exact = {(d, i) for d, text in docs for i, item in items if item in text}
    assert exact and {k for k, v in got.items() if v == 0} == exact


@pytest.mark.parametrize("block_chars", [60, 10**6])
def test_blocks_edges_and_clashing_names(spark, block_chars):
    items = [(1, "The quick brown fox jumps over it"), (2, "the  quick brown fox\njumps over it"), (3, "short"), (4, None),
             (5, ""), (6, "another item that is long enough to count")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "x THE QUICK brown fox  jumps over it y", 7), (2, None, 7), (3, "", 7), (4, "short", 7),
            (5, "pad " * 5000 + "another item thut is long enough to count", 7), (None, "the quick brown fox jumps over it", 7)]
    df = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, leaks int").withColumn("item_id", F.lit("z"))
    out = contamination.leaks(df, bench, common.work_dir(spark, "t"), block_chars=block_chars)
    assert out.columns == ["doc_id", "text", "item_id", "leaks"]
    got = sorted((r.doc_id or 0, sorted((x.item_id, x.distance) for x in r.leaks)) for r in out.collect())
    both = [(1, 0), (2, 0)]
    assert got == [(0, both), (1, both), (1, both), (2, []), (3, []), (4, [(3, 0)]), (5, [(6, 1)])]
    assert contamination.leaks(df.limit(0), bench, common.work_dir(spark, "t")).count() == 0
    none = contamination.leaks(df, bench.limit(0), common.work_dir(spark, "t"))
    assert none.where(F.size("leaks") > 0).count() == 0


def test_short_items_are_whole_lines_or_texts(spark):
    items = [(1, "What is 2 + 2?\n4"), (2, "yes"), (3, "a b"), (4, " \n "), (5, "YES ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["what is 2 + 2? 4", "They said yes to that", "one line\r\n  Yes\t\nyes", "a\nb", "x a b y", "b\n\n\u2028a  B", "yes" * 9, " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = contamination.leaks(docs, bench, common.work_dir(spark, "t"))
    got = {r.doc_id: [(x.item_id, x.distance, normal(texts[r.doc_id])[x.start:x.end], x.start) for x in r.leaks] for r in out.collect()}
    assert {i: sorted(x) for i, x in got.items()} == {
        0: [(1, 0, "what is 2 + 2? 4", 0)], 1: [], 2: [(2, 0, "yes", 9), (5, 0, "yes", 9)], 3: [(3, 0, "a b", 0)],
        4: [], 5: [(3, 0, "a b", 2)], 6: [], 7: []}


def test_lines_have_their_places():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\r\t\u2028\x1cΣİ") for _ in range(rng.randint(0, 30)))
        whole = normal(text)
        assert " ".join(line for _, line in contamination.lines(text)) == whole
        assert all(whole.startswith(line, at) for at, line in contamination.lines(text))
