"""Classes against all pairs, and signatures against true similarities."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import common, near_dedup, queries
from tidemark.llm.components import components
from tidemark.llm.shingles import Shingler, cells, jaccard

SF = "/root/testdata/sf0.01"


def bag(text):
    words = re.findall(r"\w+", (text or "").lower())
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


def brute(rows):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, one in enumerate(bags):
        for s in one:
            where.setdefault(s, []).append(i)
    for i, one in enumerate(bags):
        for j in {j for s in one for j in where[s] if j < i}:
            if similarity(one, bags[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return sorted(sorted(rows[i][0] for i in g) for g in groups.values())


def classes(found, key="doc_id"):
    groups = {}
    for r in found.collect():
        groups.setdefault(r.class_id, []).append(r[key])
    assert all(c == min(g) for c, g in groups.items())
    return sorted(sorted(g) for g in groups.values())


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = classes(queries.op1_near_dedup(spark, SF))
    assert got == brute(rows)
    assert any(len(g) > 1 for g in got)


def test_signature_estimates_weighted_similarity():
    rng = random.Random(3)
    shingler = Shingler(1)
    for overlap in (0.2, 0.5, 0.8):
        a, b = Counter(), Counter()
        for i in range(300):
            n = rng.randint(1, 4)
            a[f"w{i}"] = n
            b[f"w{i}" if rng.random() < overlap else f"v{i}"] = max(1, n + rng.randint(-1, 1))
        sets = [cells(shingler.word_hashes([" ".join(x.elements())])[0]) for x in (a, b)]
        assert jaccard(*sets) == pytest.approx(similarity(a, b))
        signs = [near_dedup.signature(s, 2000) for s in sets]
        assert np.mean(signs[0] == signs[1]) == pytest.approx(similarity(a, b), abs=0.05)
    assert len(set(near_dedup.signature(np.array([5], np.uint64), 64).tolist())) == 64


def family(rng, n, edits):
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = [" ".join(words)]
    for i in range(n):
        copy = list(words)
        for at in rng.sample(range(150), edits):
            copy[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("small", "block"), [(24, 512), (2, 7)])
def test_families_around_an_origin(spark, small, block):
    # Copies are near their origin, as a rule not near each other; large buckets go through blocks.
    rng = random.Random(4)
    texts = family(rng, 40, 4) + family(rng, 40, 3) + family(rng, 30, 9) + family(rng, 2, 1)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_dedup.near_duplicates(df, common.work_dir(spark, "t"), small=small, block=block)
    assert classes(found) == brute(rows)


def test_edges(spark, edges):
    df = edges.withColumnRenamed("ids", "class_id").withColumnRenamed("start", "label")
    found = near_dedup.near_duplicates(df, common.work_dir(spark, "t"))
    assert found.columns == ["doc_id", "class_id", "text_key"]
    got = sorted((r.doc_id, r.class_id) for r in found.collect() if r.doc_id is not None)
    assert got == [(-7, -7), (1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 5)]
    assert [r.class_id for r in found.where("doc_id IS NULL").collect()] == [None]
    assert near_dedup.near_duplicates(df.limit(0), common.work_dir(spark, "t")).count() == 0


def test_joined_links_connect_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:180 - 4 * i], rng.integers(0, 2**60, 5).astype(np.uint64)])) for i in range(6)]
    names = [bytes([i]) for i in range(6)]
    links = near_dedup.joined(sets, 3, 0.8, names[:3], names[3:], names[:3], names[3:])
    assert all(jaccard(sets[a[0]], sets[b[0]]) >= 0.8 for a, b in links) and len(links) == 5


def test_components_of_paths_and_stars(spark):
    rng = random.Random(6)
    path = list(range(60))
    rng.shuffle(path)
    links = [*zip(path, path[1:]), *((100, i) for i in range(101, 160)), (200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in components(df, common.work_dir(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
