"""Divergence of sources against SQL and a plain computation."""

import re
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tidemark.llm import common, divergence, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs=3, top=200):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in names), Counter()))
        p = {s: shares(counts[lang, s]) for s in names}
        for s in names:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in names if o != s]
            term = [
                (t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]
            ]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found = items if part == "pair" else items[:top]
                out += [(lang, s, part, i, v, rank + 1) for rank, (i, v) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_equals_sql(spark):
    sys.path.insert(0, "tests")
    from compare import duck, spark_rows, sql_rows

    found = spark_rows(queries.op11_divergence(spark, SF))
    assert found == sql_rows(duck(SF), queries.ORACLE_SQL["op11_divergence"])
    assert len(found[1]) > 1000


@pytest.mark.parametrize("postings,top", [(10, 3), (200, 5), (10**6, 200)])
def test_blocks_and_tops(spark, documents, postings, top):
    rows = documents.limit(120).select("lang", "source", "text")
    plain_rows = plain([tuple(r) for r in rows.collect()], top=top)
    rows = spark.createDataFrame(rows.toArrow())
    folder = common.work_dir(spark, "t")
    assert got(divergence.compare_sources(rows, folder, top=top, postings=postings)) == plain_rows


def test_edges(spark):
    """Null and empty texts, groups without terms, languages without kept terms, clashing names, repeated rows, ties."""
    rows = [
        ("en", "a", "Ünd ÜND a-b c3d e_f \x00g"), ("en", "a", "ünd a b"), ("en", "b", "a b " * 50_000), ("en", "c", None),
        ("en", None, ""), ("en", "b", "a b ünd"), ("en", "b", "a b ünd"), (None, "a", "x"), (None, "b", "x"), (None, "", "x"),
        ("de", "a", "eins"), ("de", "b", "zwei"), ("fr", "a", "seul seul seul"), ("日本", "a", "猫 犬"), ("日本", "b", "猫 犬"),
        ("日本", "c", "猫 犬 鳥" + "é" * 3_000_000), ("日本", "c", "\U0001f408 猫"),
    ]
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], "lang string, source string, text string, term string, n int, item string")
    assert got(divergence.compare_sources(df, common.work_dir(spark, "t"), postings=3)) == plain(rows)
    empty = df.where("false")
    assert got(divergence.compare_sources(empty, common.work_dir(spark, "t"))) == []


def test_tasks_pass_on_counts_when_they_hold_many(spark, documents, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 64)
    for text in ("", "one", "a" * 500 + " b", "Word, word. " * 40):
        found = [t for part in divergence.terms_of(text.encode()) for t in part]
        assert found == [t.encode() for t in TERM.findall(text.translate(LOWER))]


def test_shares_are_exact_for_large_counts():
    import numpy as np

    n, total = np.array([0, 5, 8 * 10**15]), np.array([3, 9 * 10**15, 9 * 10**15])
    want = [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total)]
    assert divergence.share(n, total).tolist() == want


def test_scatter_in_pieces(monkeypatch):
    table = pa.table({"source": ["a", "b", "c"], "total": [6, 5, 0], "kept": [3, 3, 3], "lang_total": [11, 11, 11]})
    block = pa.table({
        "term": ["x", "y", "z"], "n": [6, 3, 2], "sources": [["a", "b"], ["b"], ["a"]], "counts": [[4, 2], [3], [2]],
    })
    whole = divergence.block_sums("l", table, block, 9)
    monkeypatch.setattr(divergence, "GATHER", 1)
    assert divergence.block_sums("l", table, block, 9).equals(whole)
