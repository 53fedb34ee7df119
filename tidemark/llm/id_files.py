"""Token-id files: documents in ascending id order, each compressed on its own with a shared dictionary.

A file holds a header (dictionary hash, width of an id, counts), an index (document id, first token, token count,
frame offset) and one zstandard frame per document, so that a short document is read with one seek. The dictionary
is trained on the serialized id arrays of a bounded sample of all documents, drawn by hashes of their ids, and kept
beside the files.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.token_ids import encoder

MAGIC = b"IDFILE1\n"
SUFFIX = ".ids"
SAMPLE_DOCS = 1024
SAMPLE_BYTES = 4096
WINDOWS = 4
DICTIONARY_BYTES = 1 << 16
FILE_BYTES = 8 << 20


def serialized(ids: np.ndarray, width: int) -> bytes:
    """Ids as little-endian unsigned integers of ``width`` bytes."""
    return ids.astype(f"<u{width}").tobytes()


def width_of(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def _spread(ids: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` ids, from windows spread over all."""
    if len(ids) <= most:
        return ids
    size = most // WINDOWS
    starts = np.linspace(0, len(ids) - size, WINDOWS).astype(int)
    return np.concatenate([ids[at : at + size] for at in starts])


def train_dictionary(
    documents: DataFrame, tokenizer: str, end_id: int, text_col: str = "text", sample: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
) -> bytes:
    """A dictionary from the ``sample`` documents with the smallest id hashes, ``SAMPLE_BYTES`` of the ids of each.

    The bound concerns training only. Documents come from the whole table, and the ids of a long one from windows
    spread over it; the order of rows and files has no influence. Too few samples to train on give their plain content
    as dictionary.
    """
    enc = encoder(tokenizer)
    width = width_of(max(enc.size, end_id + 1))
    # No id needs more than 16 characters of plain text; longer ones only make a sample shorter.
    size = 16 * SAMPLE_BYTES // width // WINDOWS
    text, places = F.coalesce(F.col(text_col), F.lit("")), [F.lit(i / (WINDOWS - 1)) for i in range(WINDOWS)]
    parts = [F.substring(text, ((F.length(text) - size) * at).cast("int") + 1, F.lit(size)) for at in places]
    some = F.when(F.length(text) <= WINDOWS * size, text).otherwise(F.concat(*parts)).alias("t")
    hashed = F.xxhash64(F.col(id_col).cast("long")).alias("h")
    last = documents.select(hashed).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = documents.where(hashed <= F.lit(last)).select(hashed, some)
    texts = [r.t for r in rows.orderBy("h", F.xxhash64("t"), "t").limit(sample).collect()]
    samples = [serialized(_spread(np.append(i, end_id), SAMPLE_BYTES // width), width) for i in enc.encode(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, b"\0")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def pack_file(
    keys: list[int | None], firsts: list[int], counts: list[int], frames: list[bytes], digest: str, width: int
) -> bytes:
    """One file's bytes."""
    header = json.dumps({
        "dictionary_sha256": digest, "id_bytes": width, "documents": len(keys), "tokens": sum(counts),
    }).encode()
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8")
    return b"".join([
        MAGIC, struct.pack("<I", len(header)), header,
        np.array([k is not None for k in keys], "u1").tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array(firsts, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), offsets.tobytes(), *frames,
    ])


class IdFile:
    """Reads a file's documents, one at a time."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not an id file")
        at = len(MAGIC) + 4
        size = struct.unpack("<I", data[at - 4 : at])[0]
        self.header = json.loads(bytes(data[at : at + size]))
        if self.header["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the file was written with another dictionary")
        n, at = self.header["documents"], at + size
        known = np.frombuffer(data, "u1", n, at)
        columns = [np.frombuffer(data, "<i8", m, at + n + 8 * n * k) for k, m in enumerate((n, n, n, n + 1))]
        keys, self.first, self.count, self.offset = columns
        self.keys = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.body = at + n + 8 * (4 * n + 1)
        self.data, self.frames = data, zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at ``place``; only its frame is read."""
        start, end = self.body + self.offset[place], self.body + self.offset[place + 1]
        raw = self.frames.decompress(self.data[start:end])
        return np.frombuffer(raw, f"<u{self.header['id_bytes']}").astype("<u4")


def write_ids(
    documents: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write every document of ``documents`` to ``folder``; returns the manifest, one row per file.

    Whole texts are encoded (null as empty) and end with ``end_id``. Documents are spread by ranges of their id, so
    files are in ascending order; equal ids stay together, in the order of their texts. A file ends once it has
    ``file_bytes``; a longer document has a file to itself. Files are replaced in one step under names that depend
    on the rows alone, so repeated tasks do no harm. An empty table gives no file. Other columns are not read.
    """
    spark = documents.sparkSession
    common.ship(spark)
    dictionary = train_dictionary(documents, tokenizer, end_id, text_col, id_col=id_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    common.write_file(f"{folder}/ids/{digest}.dictionary", dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = width_of(max(enc.size, end_id + 1))
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        part = TaskContext.get().partitionId()
        keys, firsts, counts, frames, size, first, number = [], [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:05d}{SUFFIX}"
            common.write_file(f"{folder}/ids/{name}", pack_file(keys, firsts, counts, frames, digest, width))
            row = {"part": part, "file": name, "documents": len(keys), "tokens": sum(counts)}
            return pa.RecordBatch.from_pylist([row], schema=MANIFEST)

        for batch in common.slices(batches):
            found = enc.encode(common.texts_of(batch.column(1)))
            for key, ids in zip(batch.column(0).to_pylist(), found):
                frame = squeeze.compress(serialized(np.append(ids, end_id), width))
                keys.append(key)
                firsts.append(first)
                counts.append(len(ids) + 1)
                frames.append(frame)
                first, size = first + len(ids) + 1, size + len(frame)
                if size >= file_bytes:
                    yield flush()
                    keys, firsts, counts, frames, size, number = [], [], [], [], 0, number + 1
        if keys:
            yield flush()

    rows = documents.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    manifest = ordered.mapInArrow(write, "part int, file string, documents long, tokens long")
    return common.written(manifest, f"{folder}/manifest")


MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers. Starts within a task's files are in their indexes; one row
    per writing task carries what stands before it.
    """
    spark = manifest.sparkSession
    common.ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            data = batch.column(2)[0].as_buffer().to_pybytes()
            file = IdFile(data, batch.column(3)[0].as_py())
            part = int(batch.column(1)[0].as_py().rpartition("/")[2].split("-")[1])
            for at in range(0, len(file), 256):
                some = range(at, min(at + 256, len(file)))
                yield pa.record_batch([
                    pa.array([part] * len(some), pa.int32()),
                    pa.array([file.keys[i] for i in some], pa.int64()),
                    pa.array(file.first[at : some.stop]), pa.array(file.count[at : some.stop]),
                    pa.array([file.ids(i).tobytes() for i in some], pa.binary()),
                ], ["part", "doc_id", "first", "n_tokens", "ids"])

    dictionary = common.read_files(spark, f"{folder}/ids", ".dictionary").select(F.col("content").alias("dictionary"))
    word = dictionary.first().dictionary  # at most DICTIONARY_BYTES
    files = common.read_files(spark, f"{folder}/ids", SUFFIX)
    found = files.select(F.lit(0).alias("x"), "path", "content", F.lit(bytes(word)).alias("dictionary")).mapInArrow(
        read, "part int, doc_id long, first long, n_tokens long, ids binary"
    )
    tasks = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    return found.join(tasks, "part").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids"
    )
