"""Main text against articles cut out by hand, and importance on small sites."""

import re
import tracemalloc
from html import unescape

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, main_text, queries
from tidemark.llm.html_dom import parse
from tidemark.llm.main_text import Marked

SF = "/root/testdata/sf0.01"


def article(html):
    """The text of the test pages' one article, whose blocks are paragraphs and a title."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
    blocks = [unescape(re.sub(r"</?b>|<br>", " ", x)) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def test_query_equals_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op2_main_text(spark, SF).collect()
    assert sorted(r.page_id for r in found) == sorted(pages)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


def read(html):
    return Marked(parse(html)).text()


def test_declared_parts_go():
    html = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="page">
    <header><h1>Site</h1></header><nav>Menu <p>x</nav><div id="cookie-notice">We use cookies</div>
    <main><article class="post"><header><h1>Title &amp; more</h1><p>By A</p></header>
    <p>One <b>b</b>old<i>er</i>&nbsp;line<br>two<p>Unclosed &lt;p&gt; <script>var a = "</p><p>no";</script>end
    <div class="share-buttons">Share</div><ul><li>first<li>second</ul><pre>a
    b</pre><form>Name <input></form><div class="ad">Buy</div>
    <section class="comments"><article>Nice!</article></section><footer>Tags</footer></article></main>
    <aside>More</aside><div class="sidebar">Links</div><footer>&copy; 2024</footer></body></html>"""
    assert read(html) == "Title & more\nOne bolder line two\nUnclosed <p> end\nfirst\nsecond\na b"


STORY = "<h1>Title</h1><p>One story, told in full.</p>"
TOLD = "Title\nOne story, told in full."


@pytest.mark.parametrize("html, text", [
    (f'<body><div class="content has-sidebar"><article>{STORY}</article></div></body>', TOLD),
    (f'<div id="wrap" class="no-sidebar"><div class="social-wide"><main>{STORY}</main></div></div><p>end</p>', TOLD),
    (f'<form id="search-form"><div class="hidden rail"><article>{STORY}</article></div></form>', TOLD),
    (f'<article>{STORY}<section id="discussion"><h2>Discussion</h2><p>We find much.</p></section>'
     '<p class="share-price">It fell.</p><div class="share-price">42 USD</div>'
     '<section class="related-work"><p>Others did.</p></section></article>',
     f"{TOLD}\nDiscussion\nWe find much.\nIt fell.\n42 USD\nOthers did."),
    (f'<div class="content has-sidebar">{STORY}</div><div class="sidebar"><p>Links</p></div>', TOLD),
    (f'<div class="skip-lazy widget-area">{STORY}</div><div class="sidebar"><p>Links</p></div>', TOLD),
    ('<div class="social"><p>a</p></div><div class="rail"><p>b</p></div>', "a\nb"),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p><xmp><b> &amp; c</xmp><p>end</article>",
     "So x=2.\n<b> &amp; c\nend"),
])
def test_names_alone_lose_no_article(html, text):
    assert read(html) == text


def test_names_alone_lose_no_article_of_a_site(spark):
    page = (
        '<body class="no-sidebar"><div class="content has-sidebar"><article><p>Story {0} of {1}</p>'
        '<section id="discussion"><p>Point {0}</p></section><math><mi>x</mi><mo>=</mo></math></article></div>'
        '<div class="widget"><article><p>Always here</p></article></div><footer>us</footer></body>'
    )
    rows = [(i, f"http://h.example/{i}", page.format(i, "w" * i)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = main_text.main_text(df, common.work_dir(spark, "t")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i} of {'w' * i}".rstrip() + f"\nPoint {i}\nx=" for i in range(9)}


def test_broken_markup_is_read():
    assert read("") == "" and read("a < b <b>c") == "a < b c"
    assert read("<article><p>x<p title='>'>y<!-- <p>no") == "x\ny"
    assert read("<article>x <a href=\"q>r</a> s") == "x r\" s" or "x" in read("<article>x <a href=\"q>r</a> s")
    assert read("<p>x<script>never closed <p>y") == "x"
    assert read("<div " + "a" * 50_000 + "='" * 50_000) == ""
    assert read("<article>" + "<div>" * 20_000 + "deep") == "deep"
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert read("<div class='post-body'>main</div><div>other</div>") == "main"


def site(n, host="h.example"):
    """Pages without telling names: a banner and a box that are the same on all, an article that differs."""
    page = "<body><div class=x1><p>Welcome to us</p></div><div class=x2><p>story {0} of</p><p>it {1}</p></div><div class=x3>© us</div></body>"
    return [(i, f"http://{host}/{i}", page.format(i * 7, "w" * i)) for i in range(n)]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_same_branches_of_a_site_go(spark, threshold):
    """Whether Spark broadcasts the low branches or not."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        _same_branches(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _same_branches(spark):
    rows = [*site(12), *site(2, "small.example")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.text for r in main_text.main_text(
        df, common.work_dir(spark, "t")).collect()}
    for i, url, _ in rows:
        if "small" in url:
            assert got[i, url].startswith("Welcome") and got[i, url].endswith("© us")
        else:
            assert got[i, url] == f"story {i * 7} of\nit {'w' * i}".rstrip()


def test_copies_are_no_evidence(spark):
    html = "<body><div class=a><p>only text</p></div></body>"
    rows = [(i, "http://h.example/", html) for i in range(20)] + [(50 + i, "http://g.example", "<article><div><p>same text</p></div></article>" + f"<p>{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = main_text.main_text(df, common.work_dir(spark, "t")).collect()
    assert {r.text for r in got} == {"only text", "same text"} and len(got) == 29


def test_edges(spark):
    rows = [(1, None, None), (None, "no url", "<p>x"), (2, "http://h/", ""), (2, "http://h/", ""), (3, "http://[", "<p>y" * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("low", F.lit(2))
    got = main_text.main_text(df, common.work_dir(spark, "t"))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text[:4]) for r in got.collect()) == [(0, "x"), (1, ""), (2, ""), (2, ""), (3, "y\ny\n")]
    assert main_text.main_text(df.limit(0), common.work_dir(spark, "t")).count() == 0


def test_deep_nesting_is_held_once():
    page = parse("<p>text</p>" + "".join(f"<div class=c{i % 7}>some words {i}" for i in range(20_000)))
    tracemalloc.start()
    marked = Marked(page)
    assert len(marked.nodes()) == 20_001 and len(set(marked.keys)) == 20_002
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_contents_are_sequences_of_texts():
    def content(html):
        marked = Marked(parse(html))
        return marked.nodes()[marked.keys[1]][1]

    same = content("<div><p>a b</p><p>c</p></div>")
    assert same == content("<div> <p>a  b</p>\n<div><span>c</span></div> </div>")
    assert same == content("<div>a b<p>c</p></div>")
    assert len({same, content("<div><p>c</p><p>a b</p></div>"), content("<div><p>a b</p></div>"), content("<div></div>")}) == 4


def test_declared_parts_are_in_no_tree(spark):
    rows = [(i, "h.example", f"<nav>Menu</nav><div class=x>same</div><div class=y>other {i}</div>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, host string, html string").select("host", "html")
    nodes, low = main_text.low_branches(pages, common.work_dir(spark, "t"))
    assert nodes.select("key").distinct().count() == 2 and low.count() == 1
