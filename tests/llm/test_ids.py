"""Id files and packing against plain encoding by the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common, id_files, packing, queries
from tidemark.llm.token_ids import TokenEncoder

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in (queries.BYTE_BPE, queries.WORD_BPE))


def plain(path, texts, end):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [[*x.ids, end] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path, documents):
    texts = [r.text for r in documents.select("text").collect()]
    texts += ["", " ", "a\x85b\x1cc", "É İ ſ é don't DON'T", "日本 x", "x  \n\n y", "1234 5"]
    encode = TokenEncoder(path, max_words=500)
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        assert [[*map(int, x), 2] for x in encode.encode(some)] == plain(path, some, 2)


def check_files(found, rows):
    want, start = [], 0
    for (key, text), ids in zip(rows, plain(BYTE, [t for _, t in rows], 2)):
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "")


def test_id_files_query(spark, documents):
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), key=order)
    check_files(queries.op5_id_files(spark, SF).collect(), rows)


def test_id_files_edges_and_short_access(spark, edges):
    folder = common.work_dir(spark, "t")
    manifest = id_files.write_ids(edges, folder, BYTE, 2, file_bytes=40)
    found = id_files.read_ids(manifest, folder)
    rows = sorted(((r.doc_id, r.text) for r in edges.collect()), key=order)
    check_files(found.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect(), rows)
    files = common.read_files(spark, f"{folder}/ids", ".ids").collect()
    assert len(files) == manifest.count() > 2
    word = bytes(common.read_files(spark, f"{folder}/ids", ".dictionary").first().content)
    file = id_files.IdFile(bytes(files[0].content), word)
    assert file.ids(0)[-1] == 2 and file.header["id_bytes"] == 2
    with pytest.raises(ValueError):
        id_files.IdFile(bytes(files[0].content), word + b"x")


def test_dictionary_is_of_the_whole_table(spark):
    # Clustered by source: the second comes after more documents than the sample holds.
    rows = [(i, ("alpha beta gamma " if i < 1500 else "delta epsilon zeta ") * 9 + str(i)) for i in range(3000)]
    rows[7] = (7, "word " * 50_000 + "end")
    schema = "doc_id long, text string"
    one, other = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema)
    word = id_files.train_dictionary(one, BYTE, 2)
    assert word == id_files.train_dictionary(other, BYTE, 2)
    second = np.array(plain(BYTE, [" epsilon zeta delta epsilon"], 2)[0][:-1], "<u2").tobytes()
    assert second in word


def test_empty_tables(spark, edges):
    none = edges.limit(0)
    folder = common.work_dir(spark, "t")
    assert id_files.read_ids(id_files.write_ids(none, folder, BYTE, 2), folder).count() == 0
    pieces = packing.pieces_of(none, WORD, 1)
    assert packing.pack(pieces, common.work_dir(spark, "t")).count() == 0


def check_packing(found, rows, capacity=4096):
    want = []
    for (key, _), ids in zip(rows, plain(WORD, [t for _, t in rows], 1)):
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((key, piece, at, len(part), crc(part)))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(want, key=key)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r[3] for r in want)


def test_pack_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    bins, tokens = check_packing(queries.op6_pack(spark, SF).collect(), rows)
    assert bins == -(-tokens // 4096)


def test_pack_edges_and_sequences(spark, edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    pieces = packing.pieces_of(edges, WORD, 1).withColumn("ids_crc32", F.crc32("ids")).withColumn("offset", F.lit("x"))
    packed = packing.pack(pieces, common.work_dir(spark, "t")).cache()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing(packed.select(columns).collect(), rows)
    parts = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(parts[k] for k in sorted(parts) if k[0] == r.sequence_id)


def test_plan_uses_all_and_fits():
    rng = random.Random(4)
    for capacity in (7, 50, 400):
        histogram = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(30)}
        plan = packing.plan_bins(histogram, capacity)
        used = {}
        for times, bin_ in plan:
            assert sum(bin_) <= capacity and times > 0
            for x in bin_:
                used[x] = used.get(x, 0) + times
        assert used == histogram
        greedy, left = 0, dict(histogram)
        while any(left.values()):
            gap, greedy = capacity, greedy + 1
            while fit := max((x for x, n in left.items() if n and x <= gap), default=0):
                left[fit] -= 1
                gap -= fit
        assert sum(t for t, _ in plan) <= greedy
    with pytest.raises(ValueError):
        packing.plan_bins({8: 1}, 7)


def test_replacement_by_two():
    # Greedy gives 6+3; with the 3 back, 2+2 fill the gap of 4 more tightly.
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
