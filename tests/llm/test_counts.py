"""Unigram counts against a tokenizer built from the same vocabulary."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from tidemark.llm import queries, unigram_count
from tidemark.llm.unigram_count import SPACE, UnigramCounter

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.PIECES)


def reference(pieces, byte_fallback):
    vocab = [("<unk>", 0.0), *([(f"<0x{i:02X}>", 0.0) for i in range(256)] if byte_fallback else []), *pieces]
    # The lowest score must be that of the pieces; marks in angle brackets do not occur in the texts.
    tokenizer = Tokenizer(models.Unigram(vocab, 0, byte_fallback))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend(SPACE), normalizers.Replace(" ", SPACE)])
    return tokenizer


def counts(tokenizer, texts):
    return [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_query_equals_tokenizer(spark, documents):
    tokenizer = reference(*unigram_count.vocabulary(PATH))
    rows = {r.doc_id: r.text for r in documents.collect()}
    want = dict(zip(rows, counts(tokenizer, list(rows.values()))))
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("whole", [False, True])
def test_ties_and_unknown_characters(byte_fallback, whole):
    rng = random.Random(5)
    letters = "ab" + SPACE
    pieces = {SPACE: -2.0, "a": -1.0}
    while len(pieces) < 14:
        piece = "".join(rng.choice(letters[:2]) for _ in range(rng.randint(2, 4)))
        pieces[rng.choice(["", SPACE]) + piece] = float(-rng.randint(1, 4))
    if whole:
        pieces["a" + SPACE + "b"] = -1.0
    counter = UnigramCounter(list(pieces.items()), byte_fallback, max_units=20)
    assert counter.by_unit != whole
    texts = ["".join(rng.choice("aabb  cé") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    got = [c for t in texts for c, _ in counter.count([t])]
    assert got == counts(reference(list(pieces.items()), byte_fallback), texts)


def test_long_units_and_spaces():
    pieces, fallback = unigram_count.vocabulary(PATH)
    counter = UnigramCounter(pieces, fallback)
    texts = ["x" * 5000, "  a   b  ", "a\n\nb " + "word " * 3000, " ", "日本語 text", "tab\tend ", "q" * 70 + "  " + "r" * 3]
    tokenizer = reference(pieces, fallback)
    assert [c for c, _ in counter.count(texts)] == counts(tokenizer, texts)


def test_edges(spark, edges):
    got = unigram_count.token_counts(edges, PATH).collect()
    assert len(got) == edges.count()
    assert sorted((r.n_tokens, r.score) for r in got if r.doc_id in (1, 2)) == [(0, 0.0), (0, 0.0)]
    assert {r.n_tokens for r in got if r.doc_id == 3} == {counts(reference(*unigram_count.vocabulary(PATH)), ["one"])[0]}
    assert unigram_count.token_counts(edges.limit(0), PATH).count() == 0
