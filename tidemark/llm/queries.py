"""One query per operator with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    backoff_lm,
    common,
    contamination,
    divergence,
    id_files,
    language,
    main_text,
    near_dedup,
    packing,
    pivot_search,
    turn_repair,
    unigram_count,
    vantage,
    warc,
)

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), common.work_dir(spark, "near-dedup"))
    return found.select("doc_id", "class_id")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    found = main_text.main_text(table(spark, sf_dir, "pages"), common.work_dir(spark, "main-text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of those outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    return backoff_lm.score(documents, language.held_out(fold=1), common.work_dir(spark, "backoff-lm"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: one row per capture."""
    folder = common.work_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = common.written(warc.read_records(spark, folder).drop("payload"), f"{folder}/records")
    found = warc.captures(records).select(
        F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("refers_to"),
        F.col("response.record_type").alias("record_type"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.target_uri").alias("target_uri"),
        F.element_at(F.col("metadata")[0]["fields"], "page-id").cast("long").alias("page_id"),
    )
    # A revisit has no payload of its own: its length and the page it refers to are those of the response.
    first = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"), F.col("page_id").alias("first_page")
    )
    # Responses refer to nothing; a key of their own, which no response has, spreads them over the tasks.
    revisit = F.col("record_type") == "revisit"
    found = found.withColumn("refers_to", F.coalesce("refers_to", F.concat(F.lit("-"), "record_id")))
    return found.join(first, "refers_to", "left").select(
        "page_id", F.when(revisit, F.col("first_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", F.when(revisit, F.col("first_page")).alias("refers_to"), "target_uri",
    )


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to files in order and read back."""
    folder = common.work_dir(spark, "id-files")
    manifest = id_files.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), 2)
    found = id_files.read_ids(manifest, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    return packed(spark, table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, documents: DataFrame) -> DataFrame:
    pieces = packing.pieces_of(documents, public_tokenizers.path(WORD_BPE), 1)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest, common.work_dir(spark, "packing"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").where(pivot_search.usable("embedding"))
    vectors = vectors.select("vec_id", pivot_search.scaled("embedding").alias("vector"))
    return pivot_search.top_k(vectors, F.col("vec_id") % 50 == 0, common.work_dir(spark, "top-k"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contamination.leaks(documents, benchmark, common.work_dir(spark, "leaks"), ["doc_id"])
    return found.select("doc_id", F.inline("leaks"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram vocabulary."""
    return unigram_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def language_model(spark: SparkSession, sf_dir: str) -> language.LanguageModel:
    """Learned from every labelled document outside the held-out fold."""
    return language.train(table(spark, sf_dir, "documents").where(~language.held_out()))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and of the spans in it."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = language.identify(documents, language_model(spark, sf_dir))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the words of every source are from those of each other source of its language, and its own terms."""
    return divergence.compare_sources(table(spark, sf_dir, "documents"), common.work_dir(spark, "divergence"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults and the cheapest repair of its structure."""
    damaged = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.repair(damaged, common.work_dir(spark, "turn-repair"))


def op13_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return vantage.nearest(vectors, F.col("vec_id") % 20 == 0, common.work_dir(spark, "vantage"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_main_text": op2_main_text,
    "op3_backoff_lm": op3_backoff_lm,
    "op4_warc": op4_warc,
    "op5_id_files": op5_id_files,
    "op6_pack": op6_pack,
    "op7_top_k": op7_top_k,
    "op8_contamination": op8_contamination,
    "op9_token_counts": op9_token_counts,
    "op10_language": op10_language,
    "op11_divergence": op11_divergence,
    "op12_turn_repair": op12_turn_repair,
    "op13_vantage": op13_vantage,
}
ORACLE_SQL: dict[str, str] = {
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), w AS (
            SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), c AS (
            SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL
        ), k AS (
            SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3
        ), l AS (
            SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), s AS (
            SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v, coalesce(sum(c.n), 0) AS n
            FROM g LEFT JOIN l USING (lang)
                LEFT JOIN (SELECT * FROM c SEMI JOIN k USING (lang, term)) c USING (lang, source)
            GROUP BY ALL
        ), p AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + s.v) AS p
            FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
        ), q AS (
            SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q FROM k JOIN l USING (lang)
        ), f AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), o AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN q USING (lang, term)
            WHERE n > 0 AND p > q
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o
        )
        SELECT * FROM r WHERE part = 'pair' OR rank <= 200
    """,
}
