"""The pipeline's stages, each on its own input, against plain versions."""

import sys

from pyspark.sql import functions as F

sys.path.insert(0, "tests/llm")

import corpus_pipeline as pipeline  # noqa: E402
from test_ids import check_packing  # noqa: E402
from test_near_dedup import brute  # noqa: E402

from tidemark.llm import common, queries  # noqa: E402
from tidemark.llm.contamination import normal  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, folder = docs.columns, common.work_dir(spark, "t")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = queries.language_model(spark, SF)
    found = model.identify([t for _, t in rows])
    rows = [r for r, (lang, score, _) in zip(rows, found) if lang != "und" and score >= 0.3]

    docs = common.written(pipeline.language_id(spark, docs, SF), f"{folder}/1")
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(d for d, _ in rows)
    groups = brute(rows)
    docs = common.written(pipeline.one_of_each(spark, docs, SF), f"{folder}/2")
    kept = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and len(kept) == len(groups) < len(rows)
    assert all(len(kept & set(g)) == 1 for g in groups)
    rows = [r for r in rows if r[0] in kept]

    items = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in rows if not any(i in normal(r[1]) for i in items)]
    docs = common.written(pipeline.decontaminate(spark, docs, SF), f"{folder}/3")
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {d for d, _ in clean}
    assert len(clean) < len(rows)

    bins, tokens = check_packing(pipeline.pack(spark, docs, SF).collect(), clean)
    assert bins <= -(-tokens // 4096) + 1


def test_stages_keep_clashing_columns(spark, edges):
    names = ["lang_pred", "score", "leaks", "row", "n", "key", "_"]
    docs = edges.select("doc_id", "text", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    docs = common.written(docs, common.work_dir(spark, "t"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(list(r)[2:] == list(range(len(names))) for r in got)
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    kept = pipeline.one_of_each(spark, docs, SF).collect()
    assert len(kept) == docs.count() - 1  # of the repeated row one stays


def test_dedup_keeps_its_numbers_when_scans_split_differently(spark, monkeypatch):
    text = "a text number {0} with words of its own {0} and {0} some more of them {0} until the end {0}"
    rows = [(i, text.format(f"w{i % 30}x")) for i in range(40)]
    folder = common.work_dir(spark, "t")
    for part in range(8):
        spark.createDataFrame(rows[part::8], "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    found = pipeline.near_dedup.near_duplicates

    def then_fewer_cores(*args, **kwargs):
        classes = found(*args, **kwargs)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return classes

    monkeypatch.setattr(pipeline.near_dedup, "near_duplicates", then_fewer_cores)
    spark.conf.set("spark.sql.files.minPartitionNum", "8")
    try:
        kept = [r.text for r in pipeline.one_of_each(spark, spark.read.parquet(folder), SF).collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(kept) == sorted({t for _, t in rows})


def test_language_stage_rejects_unknown_and_keeps_mixes(spark):
    text = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if len(r.text) > 300 and "|" not in r.text:
            text.setdefault(r.lang, r.text[:300].rsplit(" ", 1)[0])
    assert len(text) == 4
    mix = " ".join(x[:240].rsplit(" ", 1)[0] for x in text.values())
    rows = [(1, "这是一个完整的中文文档"), (2, "Это полностью русский текст о жизни"), (3, "xqzv kjwq zzxv pqpq"), (4, mix)]
    rows += [(5 + i, x) for i, x in enumerate(text.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.language_id(spark, docs, SF).collect()) == [4, 5, 6, 7, 8]
