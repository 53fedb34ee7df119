"""WARC archives of page captures, and their assembly into one nested row per capture.

A capture is written as a request, a response (or a revisit of an equal payload) and a metadata record; request and
metadata name the response in ``WARC-Concurrent-To``. Each record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

SUFFIX = ".warc.gz"
FILE_BYTES = 8 << 20
CRAWL_DATE = "2024-01-01T00:00:00Z"
# The names of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")
RECORD = (
    "record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, "
    "refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def base32_sha1(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(row: int, kind: str) -> str:
    """A URN that depends on the row's number and the kind of record alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{kind}/{row}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _uri(url: str | None) -> str:
    """A URL as one header line; other characters percent-encoded."""
    return quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")


def _capture(row: int, page: int | None, url: str | None, html: str, first: int, first_page: int | None) -> bytes:
    """The three records of a page; a page whose row is not ``first`` revisits that row's response."""
    payload, uri = html.encode(), _uri(url)
    digest, kind = f"sha1:{base32_sha1(payload)}", "response" if first == row else "revisit"
    own = record_id(row, kind)
    shared = [("WARC-Date", CRAWL_DATE), ("WARC-Target-URI", uri)]
    parts = urlsplit(uri) if "[" not in uri and "]" not in uri else urlsplit("")
    ask = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    main = [("WARC-Type", kind), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", digest)]
    if kind == "revisit":
        main += [("WARC-Refers-To", record_id(first, "response")), ("WARC-Profile", REVISIT_PROFILE)]
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page), ("refers-to-page-id", first_page)) if v is not None)
    return b"".join([
        record([
            ("WARC-Type", "request"), ("WARC-Record-ID", record_id(row, "request")), *shared,
            ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request"),
        ], ask.encode()),
        record([*main, ("Content-Type", "application/http; msgtype=response")], head + payload * (kind == "response")),
        record([
            ("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(row, "metadata")), *shared,
            ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields"),
        ], fields.encode()),
    ])


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write every row of ``pages`` to archives in ``folder``; returns one row per file.

    Of the rows with equal payloads of ``least_bytes`` or more, the one with the smallest id (null last; then the
    first row read) becomes the response and the others revisits; shorter payloads are all responses. A null payload
    is empty, repeated rows are captures of their own. Rows are numbered as they are read, so ``pages`` should come
    from files or another source that repeats its order. Files are replaced in one step under names that depend on
    the task, so repeated tasks do no harm. An empty table gives no file; other columns are not read.
    """
    common.ship(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"),
    )
    # Rows of short payloads get keys of their own, so that they meet no other row.
    key = F.when(F.octet_length("html") >= least_bytes, F.sha1("html")).otherwise(F.col("row").cast("string"))
    rows = rows.withColumn("key", key)
    best = F.min_by(F.struct("row", "page"), F.struct(F.col("page").isNull(), "page", "row"))
    firsts = rows.groupBy("key").agg(best.alias("first"))
    chosen = rows.join(firsts, "key").select(
        "row", "page", "url", "html",
        F.col("first.row").alias("first_row"), F.col("first.page").alias("first_page"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, captures, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:05d}{SUFFIX}"
            about = record([
                ("WARC-Type", "warcinfo"), ("WARC-Date", CRAWL_DATE), ("WARC-Filename", name),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"),
                ("Content-Type", "application/warc-fields"),
            ], b"format: WARC File Format 1.1\r\n")
            common.write_file(f"{folder}/archives/{name}", b"".join([about, *captures]))
            return pa.record_batch([[name], pa.array([len(captures)], pa.int64())], ["file", "captures"])

        for batch in common.slices(batches, 256):
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                captures.append(_capture(*values))
                size += len(captures[-1])
                if size >= file_bytes:
                    yield flush()
                    captures, size, number = [], 0, number + 1
        if captures:
            yield flush()

    return common.written(chosen.mapInArrow(write, "file string, captures long"), f"{folder}/manifest")


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive, in order; payloads without their HTTP head."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers.setdefault(name.lower(), []).append(value.strip())
        first = {k: v[0] for k, v in headers.items()}
        block, kind = stream.read(int(first["content-length"])), first["warc-type"]
        http = first.get("content-type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        fields = {}
        if first.get("content-type") == "application/warc-fields":
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().splitlines()) if k}
        yield {
            "record_id": first["warc-record-id"], "record_type": kind, "target_uri": first.get("warc-target-uri"),
            "date": first.get("warc-date"), "concurrent_to": headers.get("warc-concurrent-to", []),
            "refers_to": first.get("warc-refers-to"),
            "payload_digest": first.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_bytes": len(payload), "fields": list(fields.items()), "payload": payload,
        }


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder."""
    common.ship(spark)
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
        ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            some: list[dict] = []
            for found in parse(batch.column(1)[0].as_py()):
                some.append(found)
                if len(some) >= 256:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)
                    some = []
            yield pa.RecordBatch.from_pylist(some, schema=schema)

    return common.read_files(spark, f"{folder}/archives", SUFFIX).mapInArrow(read, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, response, requests, metadata``.

    ``response`` is the response, revisit or resource record. A request or metadata record belongs to it if either
    names the other in ``concurrent_to``, or if it is linked to a request that does. Records without such a link make
    rows of their own with a null ``response``. A record linked to several responses is in each of their rows;
    records that only repeat an identifier are kept. Warcinfo records are left out. ``records`` are read several times,
    so they should be a written table.
    """
    whole = F.struct(*(c for c in records.columns))
    anchor = F.col("record_type").isin(*ANCHORS)
    anchors = records.where(anchor).select("record_id", whole.alias("response"))
    others = records.where(~anchor & (F.col("record_type") != "warcinfo"))
    named = records.select("record_id", anchor.alias("anchor"), F.explode("concurrent_to").alias("to"))
    ids = records.where(anchor).select(F.col("record_id").alias("to")).distinct()
    said = named.where(~F.col("anchor")).join(ids, "to").select("record_id", F.col("to").alias("of"))
    back = named.where("anchor").select(F.col("to").alias("record_id"), F.col("record_id").alias("of"))
    direct = said.union(back).distinct()
    loose = named.where(~F.col("anchor")).join(ids, "to", "left_anti")
    hop = loose.join(direct.select(F.col("record_id").alias("to"), "of"), "to").select("record_id", "of")
    links = direct.union(hop).distinct()
    members = others.select("record_id", "record_type", whole.alias("member")).join(links, "record_id", "left")
    own = F.coalesce("of", "record_id")
    lists = members.groupBy(own.alias("record_id")).agg(
        F.collect_list(F.when(F.col("record_type") == "request", F.col("member"))).alias("requests"),
        F.collect_list(F.when(F.col("record_type") != "request", F.col("member"))).alias("metadata"),
    )
    return anchors.join(lists, "record_id", "full_outer")
