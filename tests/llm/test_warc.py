"""Archives against digests computed directly, and assembly of hand-made records."""

import base64
import hashlib

from pyspark.sql import functions as F

from tidemark.llm import common, queries, warc

SF = "/root/testdata/sf0.001"


def expected(rows):
    first = {}
    for page, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page)
    out, used = [], set()
    for page, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        lead = first[html or ""] == page and html not in used
        used |= {html} if lead else set()
        out.append((page, len(data), digest, "response" if lead else "revisit", None if lead else first[html or ""]))
    return sorted(out, key=str)


def got(df):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=str)


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert got(queries.op4_warc(spark, SF)) == expected([(r.page_id, r.html) for r in pages.collect()])


HTML = [
    (1, "http://a.example/x y", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "same é"), (3, "u?é", "same é"), (4, "", None),
    (5, "http://[::1", ""), (6, "http://h/\r\nX: y", "z" * 100_000), (3, "u?é", "same é"), (7, "http://b/", "z" * 100_000),
]


def test_round_trip_of_edges(spark, tmp_path):
    path = str(tmp_path / "in")
    pages = spark.createDataFrame([(*r, 5) for r in HTML], "page_id long, url string, html string, row int")
    pages.coalesce(1).write.parquet(f"{path}/pages.parquet")
    assert got(queries.op4_warc(spark, path)) == expected([(r[0], r[2]) for r in HTML])


def test_payloads_and_short_ones(spark, tmp_path):
    pages = spark.createDataFrame(HTML, "page_id long, url string, html string").coalesce(1)
    folder = common.work_dir(spark, "t")
    manifest = warc.write_archives(pages, folder, least_bytes=100, file_bytes=300)
    assert manifest.count() > 1 and manifest.agg(F.sum("captures")).first()[0] == len(HTML)
    rows = warc.captures(warc.read_records(spark, folder)).collect()
    assert len(rows) == len(HTML)
    for r in rows:
        assert [m.record_type for m in r.requests] == ["request"] and len(r.metadata) == 1
        html = {(p, h) for p, _, h in HTML if str(p) == r.metadata[0].fields["page-id"]}.pop()[1] or ""
        short = len(html.encode()) < 100
        assert r.response.record_type == "response" or not short
        if r.response.record_type == "response":
            assert bytes(r.response.payload).decode() == html
            assert r.response.payload_digest == warc.base32_sha1(html.encode())


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = common.work_dir(spark, "t")
    assert warc.write_archives(pages, folder).count() == 0


def test_links_in_either_direction_and_loose_records(spark):
    rows = [
        ("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("r2", "revisit", []),
        ("q2", "request", ["r2"]), ("m2", "metadata", ["gone"]), ("i", "warcinfo", []), ("r3", "resource", []),
    ]
    # m1 names a request that its response names.
    records = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>")
    names = lambda xs: sorted(x.record_id for x in xs or [])
    found = {r.record_id: (r.response and r.response.record_id, names(r.requests), names(r.metadata))
             for r in warc.captures(records).collect()}
    assert found == {
        "r1": ("r1", ["q1"], ["m1"]), "r2": ("r2", ["q2"], []), "r3": ("r3", [], []), "m2": (None, [], ["m2"]),
    }
