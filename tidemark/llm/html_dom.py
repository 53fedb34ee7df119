"""A small tolerant HTML reader: elements in page order with parents, texts with their blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section select summary table tbody td tfoot th thead tr ul xmp".split()
)
# What an opening tag ends, up to an element of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
KEEPS_P = frozenset(["td", "th", "button", "table", "html", "body", "article", "div", "section"])

TOKEN = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Page:
    """Elements by number, in page order; number 0 is the page itself."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[dict[str, str]] = field(default_factory=lambda: [{}])
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # element, block number, text


def parse(html: str) -> Page:
    """Read any text as HTML. Raw elements (scripts, styles and their kind) keep no text, but xmp as it stands."""
    page = Page()
    stack, block, at, low = [0], 0, 0, None
    tags, texts = page.tags, page.texts
    end = len(html)
    while at < end:
        found = TOKEN.search(html, at)
        start = found.start() if found else end
        if start > at:
            text = html[at:start]
            texts.append((stack[-1], block, unescape(text) if "&" in text else text))
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name = name.lower()
        if found[1] or found[4]:
            if name == "br":
                texts.append((stack[-1], block, "\n"))
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == name:
                    block += any(tags[x] in BLOCK for x in stack[depth:])
                    del stack[depth:]
                    break
            else:
                block += name in BLOCK
            continue
        if name in CLOSES:
            _close(stack, tags, *CLOSES[name])
        if name in BLOCK:
            _close(stack, tags, frozenset(["p"]), KEEPS_P)
            block += 1
        raw = found[3] or found[6] or ""
        tags.append(name)
        page.parents.append(stack[-1])
        page.attributes.append(
            {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t\r") else {}
        )
        if name == "br":
            texts.append((stack[-1], block, "\n"))
        elif name == "hr":
            block += 1
        if name in VOID or (raw.endswith("/") and name in ("svg", "math")):
            continue
        if name in RAW:
            if low is None:
                low = html.lower()
                if len(low) != end:  # some capitals become two characters
                    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), html)
            close = low.find(f"</{name}", at)
            if name == "xmp":
                texts.append((len(tags) - 1, block, html[at : close if close >= 0 else end]))
                block += 1
            at = end if close < 0 else close
            if close >= 0:
                gt = html.find(">", close)
                at = end if gt < 0 else gt + 1
            continue
        stack.append(len(tags) - 1)
    return page


def _close(stack: list[int], tags: list[str], ended: frozenset, bounds: frozenset) -> None:
    """Pop from the outermost of ``ended`` above the nearest of ``bounds``."""
    cut = None
    for depth in range(len(stack) - 1, 0, -1):
        tag = tags[stack[depth]]
        if tag in bounds:
            break
        if tag in ended:
            cut = depth
    if cut is not None:
        del stack[cut:]
