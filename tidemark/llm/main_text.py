"""The main text of web pages by site style trees.

Pages of a host are merged into one tree: elements on the same path of tags, classes and ids are one node. For each
node, the pages' different presentations (tag structures below it) and contents (texts below it) give two entropies,
and these its importance; a branch that looks and reads the same on all pages is of low importance and is removed from
each page. Markup is prior knowledge about a node: what declares itself as navigation, advert, form, comments and so on
has no importance whatever its entropy, since such parts can differ from page to page, and is in no tree; running text inside the article
is never removed, since copies of an article, or of a passage, are still text. Words in classes and ids are weaker than
tags and roles: alone they never mark what holds or is inside an article, nor what holds most of a page's text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.html_dom import Page, parse

DECAY = 0.9
IMPORTANCE = 0.2
LEAST_PAGES = 4
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681 % ((1 << 61) - 1)
# Elements, roles and words in classes and ids that declare a part of the page.
NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe object embed applet button select textarea "
    "dialog menu canvas audio video svg map search title option input label fieldset".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion "
    "sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs masthead footer foot cookie cookies "
    "consent gdpr popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus "
    "discussion respond reply replies share sharing social related recommended recommendations widget widgets toolbar "
    "pagination pager login search aside rail skip hidden noprint".split()
)
WEAK_WORDS = frozenset("header notice notices alert message topbar top bar meta tags links form warning announcement".split())
MAIN_WORDS = frozenset("article content main post entry story text body".split())
MAIN_NAMES = MAIN_WORDS - {"text", "body"}  # as whole names; texts and bodies are also parts of widgets
CONTROL_WORDS = frozenset("button buttons icon icons link links bar box block list count tools".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WRAPPERS = frozenset(["form", "fieldset"])  # some sites put the whole page into a form
LABEL_WORDS = 3
RUNNING = HEADINGS | frozenset("section p pre blockquote li dt dd td th caption figure xmp math".split())
FLOW = HEADINGS | frozenset(
    "p pre blockquote ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption a b i em strong u s "
    "span small big sub sup code kbd samp var q cite abbr time mark font center br hr img xmp math semantics mrow mi mn mo "
    "ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mtable mtr mtd mlabeledtr maction".split()
)
UNTOUCHED = frozenset(["#page", "html", "body", "article", "main"])
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
STATE = re.compile(r"(?:has|no|with|without)(?:[-_]|(?=[A-Z]))")  # says what is elsewhere: has-sidebar


def _names(attributes: dict[str, str]) -> list[set[str]]:
    """The words of each class and of the id, without those of a state."""
    named = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split()
    return [{w.lower() for w in WORDS.findall(x)} for x in named if not STATE.match(x)]


def _words(attributes: dict[str, str]) -> set[str]:
    return set().union(*_names(attributes))


def _named(tag: str, attributes: dict[str, str]) -> bool:
    """Whether words in the class or id of an element say that it is not part of the article."""
    if not attributes or tag in UNTOUCHED or tag in HEADINGS:
        return False
    names = _names(attributes)
    words = set().union(*names)
    if words & NOISE_WORDS:
        whole = set().union(*(x for x in names if len(x) == 1))
        return bool(whole & NOISE_WORDS) or not whole & MAIN_NAMES
    return bool(words & WEAK_WORDS and not words & MAIN_WORDS)


def _control(attributes: dict[str, str]) -> bool:
    """Whether a class or the id is made of nothing but words of noise and controls."""
    return any(x & NOISE_WORDS and x <= NOISE_WORDS | CONTROL_WORDS for x in _names(attributes))


def _is_main(tag: str, attributes: dict[str, str]) -> bool:
    return tag in ("article", "main") or (attributes.get("role") or "").lower() == "main"


def _declared(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the tag, role or visibility of an element says that it is not part of the article."""
    if tag in NOISE_TAGS and (inside or tag not in WRAPPERS):
        return True
    if tag == "header" and not inside:
        return True
    if not attributes or tag in UNTOUCHED or tag in HEADINGS:
        return False
    if (attributes.get("role") or "").lower() in NOISE_ROLES or "hidden" in attributes:
        return True
    if (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style") or "", re.I))


class Marked:
    """A page with its declared noise, its article, and the keys of the style tree's nodes."""

    def __init__(self, page: Page):
        self.page = page
        n = len(page.tags)
        self.noise, self.keys, inside = [False] * n, [0] * n, [False] * n
        self.hidden = [False] * n  # noise by more than names
        named, holds = [False] * n, [False] * n
        for i in range(1, n):
            tag, parent, attributes = page.tags[i], page.parents[i], page.attributes[i]
            self.hidden[i] = self.hidden[parent] or _declared(tag, attributes, inside[parent])
            inside[i] = inside[parent] or _is_main(tag, attributes)
            if self.hidden[i]:
                continue
            named[i] = tag in WRAPPERS or _named(tag, attributes)
            at = i if _is_main(tag, attributes) else 0
            while at > 0 and not holds[at]:
                holds[at], at = True, page.parents[at]
        sizes = self._sizes() if any(named) else []
        mains: dict[str, list[int]] = {"article": [], "main": [], "named": []}
        for i in range(1, n):
            tag, parent, attributes = page.tags[i], page.parents[i], page.attributes[i]
            self.noise[i] = self.noise[parent] or self.hidden[i]
            if named[i] and not holds[i] and not self.noise[i]:
                if inside[i]:  # the names of a control, on what is a label and no running text
                    self.noise[i] = tag not in FLOW and _control(attributes) and sizes[i][1] <= LABEL_WORDS
                else:
                    self.noise[i] = 2 * sizes[i][0] <= sizes[0][0]
            label = tag
            if attributes:
                label += re.sub(r"\d{3,}", "", f".{attributes.get('class') or ''}#{attributes.get('id') or ''}")
            self.keys[i] = _number(f"{self.keys[parent]}/{label}")
            if self.noise[i]:
                continue
            if tag == "article":
                mains["article"].append(i)
            elif _is_main(tag, attributes):
                mains["main"].append(i)
            elif attributes and tag in ("div", "section", "td") and _words(attributes) & MAIN_WORDS:
                mains["named"].append(i)
        self.mains = set(next((found for found in mains.values() if found), []))
        self.declared = bool(mains["article"] or mains["main"])
        self.main = [False] * n  # inside the article
        self.over = [False] * n  # holds the article
        nested = set()
        for i in range(1, n):
            up = page.parents[i]
            # An article within an article is a comment on it.
            if i in self.mains and self.main[up] and page.tags[i] == "article":
                nested.add(i)
            self.main[i] = self.main[up] or i in self.mains
            extra = i in nested or (page.tags[up] == "header" and page.tags[i] not in HEADINGS and self.main[up])
            self.noise[i] = self.noise[i] or extra or self.noise[up]
        # Of several articles, those in parts with names of noise are left to the importance of these parts.
        strange = [False] * n
        for i in range(1, n):
            strange[i] = strange[page.parents[i]] or (named[i] and page.tags[i] not in WRAPPERS and not self.main[i])
        plain = [i for i in self.mains if not strange[i]]
        for i in plain or self.mains:
            while i > 0 and not self.over[i]:
                self.over[i], i = True, page.parents[i]

    def _sizes(self) -> list[tuple[int, int]]:
        """Characters and words of the text in each element, without hidden parts. Running text is more than a label."""
        page = self.page
        chars, words = [0] * len(page.tags), [0] * len(page.tags)
        for element, _, text in page.texts:
            if not self.hidden[element]:
                some = text.split()
                chars[element] += sum(map(len, some))
                words[element] += len(some)
        for i in range(len(page.tags) - 1, 0, -1):
            if words[i] and page.tags[i] in RUNNING:
                words[i] += LABEL_WORDS
            chars[page.parents[i]] += chars[i]
            words[page.parents[i]] += words[i]
        return list(zip(chars, words))

    def removable(self, i: int) -> bool:
        """Whether a branch may go for low importance: containers, and running text outside the article."""
        tag = self.page.tags[i]
        return not (self.noise[i] or tag in UNTOUCHED or self.over[i] or (self.main[i] and tag in FLOW))

    def nodes(self) -> dict[int, tuple[int, int]]:
        """Of each removable node's key: hashes of its presentation and its content on this page.

        A content is the sequence of texts below a node. Its hash is a polynomial of theirs, so that a node's follows
        from its children's and nothing is held twice, however deep they are nested.
        """
        page = self.page
        below: list[list[str]] = [[] for _ in page.tags]
        own, said = [(0, 1)] * len(page.tags), [(0, 1)] * len(page.tags)  # hash, and the base to the number of texts
        for element, _, text in page.texts:
            text = " ".join(text.split())
            if text:
                own[element] = _after(own[element], (_number(text), BASE))
        found: dict[int, tuple[int, int]] = {}
        for i in range(len(page.tags) - 1, 0, -1):
            up = page.parents[i]
            kind = below[i][::-1]
            # Runs of like children count as one, so that a longer list looks the same.
            kind = [k for at, k in enumerate(kind) if not at or kind[at - 1] != k]
            look = f"{page.tags[i]}({','.join(kind)})"
            look = look if len(look) < 200 else xxhash.xxh3_64_hexdigest(look)
            below[up].append(look)
            below[i] = []
            content = _after(own[i], said[i])
            said[up] = _after(content, said[up])
            if self.removable(i):
                a, b = found.get(self.keys[i], (0, 0))
                found[self.keys[i]] = (a + _number(look)) & (1 << 63) - 1, (b * 31 + content[0]) & (1 << 63) - 1
        return found

    def text(self, low: set[int] | None = None) -> str:
        """The blocks of the article, joined by line ends, without the branches whose keys are in ``low``.

        Without ``low``, for pages that belong to no tree, the markup alone decides; if it leaves nothing, all that is
        not hidden.
        """
        gone = list(self.noise)
        if low:
            for i in range(1, len(gone)):
                gone[i] = gone[i] or gone[self.page.parents[i]] or (self.keys[i] in low and self.removable(i))
        out = self._blocks(gone, bool(self.mains))
        if not out:
            return self.text() if low else self._blocks(self.hidden, False)
        return out

    def _blocks(self, gone: list[bool], only_main: bool) -> str:
        blocks, last, parts = [], None, []
        for element, block, text in self.page.texts:
            if gone[element] or (only_main and not self.main[element]):
                continue
            if block != last:
                blocks.append(parts)
                parts, last = [], block
            parts.append(text)
        blocks.append(parts)
        return "\n".join(x for x in (" ".join("".join(p).split()) for p in blocks) if x)


def host_of(url: str) -> Column:
    """The lower-case host of a URL, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _number(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace")) >> 1


def _after(first: tuple[int, int], second: tuple[int, int]) -> tuple[int, int]:
    """Hash and power of two sequences of texts, one after the other."""
    return (first[0] * second[1] + second[0]) % MODULUS, first[1] * second[1] % MODULUS


def _digest(host: str | None, html: str) -> bytes:
    return hashlib.md5(f"{host}\n{html}".encode()).digest()


def low_branches(
    pages: DataFrame, folder: str, decay: float = DECAY, importance: float = IMPORTANCE, least_pages: int = LEAST_PAGES
) -> tuple[DataFrame, DataFrame]:
    """For pages (``host``, ``html``): the nodes of each page, and (``host``, ``key``) of the branches to remove.

    A node's importance is (1 - decay^l) times its entropy of presentations plus decay^l times its entropy of contents,
    for l presentations; entropies are of base m, for m different pages with the node. Equal pages of a host count
    once. Declared noise has importance 0 without any statistics and is in neither result. Nodes on fewer than
    ``least_pages`` pages are left alone; pages without a host are in no tree. Both results are written tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 128):
            out: tuple[list, ...] = ([], [], [], [], [])
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest = _digest(host, html)
                for key, (look, text) in Marked(parse(html)).nodes().items():
                    for column, value in zip(out, (host, key, digest, look, text)):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "key", "digest", "look", "text"])

    nodes = pages.where("host <> ''").mapInArrow(run, "host string, key long, digest binary, look long, text long")
    nodes = common.written(nodes, f"{folder}/nodes")
    nodes = nodes.distinct()

    def entropy(feature: str) -> DataFrame:
        each = nodes.groupBy("host", "key", feature).agg(F.count("*").alias("n"))
        total = each.groupBy("host", "key").agg(
            F.sum("n").alias("m"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("s")
        )
        most = F.col("m") * F.log(F.greatest("m", F.lit(2)))
        return total.select("host", "key", "m", F.col("l").alias(f"{feature}_l"), (1 - F.col("s") / most).alias(feature))

    both = entropy("look").join(entropy("text").drop("m"), ["host", "key"])
    share = F.pow(F.lit(decay), F.col("look_l"))
    own = (1 - share) * F.col("look") + share * F.col("text")
    low = both.where((F.col("m") >= least_pages) & (own < importance)).select("host", "key")
    return nodes, common.written(low, f"{folder}/low")


def main_text(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    text_col: str = "text", **options,
) -> DataFrame:
    """One row per page: id, url and ``text``, the article's blocks joined by line ends.

    References are decoded, white space in a block is one space, blocks without text are left out; a null html gives an
    empty text. A null or malformed url has no host: such pages are read by their markup alone. Repeated rows each give
    their text. Where low importance would leave nothing, the text is kept. Other columns are not read.

    The low branches of each page are written by the digest of the page before they are joined to it, so that Spark
    knows how much they are: little is broadcast, much is a shuffle of the pages by digest.
    """
    common.ship(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    nodes, low = low_branches(rows.select("host", "html"), folder, **options)
    own = nodes.join(low, ["host", "key"]).groupBy("digest").agg(F.collect_set("key").alias("low"))
    own = common.written(own, f"{folder}/own")
    keyed = rows.withColumn("digest", F.unhex(F.md5(F.concat_ws("\n", "host", "html"))))
    joined = keyed.join(own, "digest", "left").select("page_id", "url", "html", "low")
    kind = joined.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 128):
            out = []
            for html, keys in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out.append(Marked(parse(html)).text(set(keys or ())))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    schema = f"page_id {kind['page_id'].dataType.simpleString()}, url string, text string"
    found = joined.mapInArrow(run, schema)
    return found.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), F.col("text").alias(text_col))
