"""Language identification: held-out accuracy, spans of mixed texts, exact labels."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return queries.language_model(spark, SF)


def test_held_out_accuracy(spark):
    found = queries.op10_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    rows = found.where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_of_mixed_text(spark, model):
    text = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where(language.held_out()).collect():
        if len(r.text) > 300 and "|" not in r.text:
            text.setdefault(r.lang, r.text[:300].rsplit(" ", 1)[0])
    mixed = text["en"] + " " + text["de"] + " " + text["fr"]
    (_, score, spans), = model.identify([mixed])
    assert [s[2] for s in spans] == ["en", "de", "fr"] and 0.2 < score < 0.6
    assert abs(spans[1][0] - len(text["en"])) < 40


def test_labels_are_the_best_path(model):
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        for _ in range(30):
            scores = rng.normal(0, 10, (n, 3))
            found = model.label(scores)
            found = [found] * n if isinstance(found, int) else list(found)
            value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - model.switch * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,E501
            assert value(found) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))


def test_scripts_narrow_candidates(spark):
    rows = [("ru", "привет мир как дела"), ("en", "hello world how are you"), ("ja", "これは日本語です 世界")]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    got = [x[0] for x in model.identify(["мама", "hello", "日本", "12 34", "ไทย", None, ""])]
    assert got[:4] == ["ru", "en", "ja", "und"] and got[4] in ("en", "ja", "ru") and got[5:] == ["und", "und"]
    (lang, _, spans), = model.identify(["hello world привет"])
    assert lang == "en" and [(a, b) for a, b, _ in spans] == [(0, 11), (12, 18)]


def test_edges(spark, edges, model):
    rows = edges.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s"))
    found = language.identify(rows, model)
    assert found.columns == ["doc_id", "text", "start", "ids", "piece", "lang_pred", "score", "spans"]
    got = found.collect()
    assert len(got) == edges.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, -7)} == {"und"}
    none = language.train(edges.limit(0).withColumn("lang", F.lit("x")))
    assert none.languages == [] and none.identify(["word"]) == [("und", 0.0, [])]
    assert language.identify(edges.limit(0), model).count() == 0


def test_long_words_and_capitals(model):
    rng = random.Random(1)
    text = "İİ " + "".join(rng.choice("abcdef") for _ in range(5000)) + " the and of to"
    (lang, _, spans), = model.identify([text])
    assert lang in model.languages and all(0 <= a < b <= len(text) for a, b, _ in spans)


def test_unknown_words_are_no_evidence(spark, model):
    rows = [(1, "这是一个完整的中文文档"), (2, "Это полностью русский текст о жизни"), (3, "xqzv kjwq zzxv pqpq wvxk jjqx"), (4, "ไทย")]
    rows += [(6, "12 + 34 = !?"), (7, None), (8, " ")]
    rows.append((5, "the time of the people and the world " * 3 + "русский"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(docs, model, evidence_col="evidence").collect()}
    assert all(got[i].lang_pred in model.languages and (got[i].score, got[i].evidence) == (0.0, 0.0) for i in (1, 2, 3, 4))
    assert {s.lang for i in (1, 2, 4) for s in got[i].spans} == {"und"}
    assert [got[i].lang_pred for i in (6, 7, 8)] == ["und"] * 3
    letters = len("".join(rows[-1][1].split()))
    assert got[5].lang_pred == "en" and got[5].spans[-1].lang == "und" and got[5].score <= 1 - 7 / letters
