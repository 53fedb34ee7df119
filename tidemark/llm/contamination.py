"""Benchmark items in documents, within a share of edits.

An item with an error budget of ``k`` edits is cut into ``k + 1`` pieces: whatever ``k`` edits do, one piece stays
whole (pigeonhole). Aho-Corasick finds all pieces of all items in a text at once; where one is found, Myers'
bit-parallel algorithm gives the least edit distance of the item to a passage around it.

Short items have no budget and are words of any text, so they are compared with whole lines and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

EDITS = 0.05
LEAST_CHARS = 20
BLOCK_CHARS = 4_000_000
LEAKS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def lines(text: str) -> Iterator[tuple[int, str]]:
    """The normalised lines of a text that are not empty, with their places in the normalised text."""
    at = 0
    for line in text.splitlines():
        line = normal(line)
        if line:
            yield at, line
            at += len(line) + 1


def pieces(item: str, edits: float) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, with their offsets."""
    budget = int(len(item) * edits)
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any passage of ``text`` and that passage's end; None if over ``most``.

    Of equal distances the first end counts.
    """
    if not pattern:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score = full, 0, len(pattern)
    best = (score, 0) if score <= most else None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        carry = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(carry | up) & full, up & carry
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1 & full, less << 1 & full
        eq |= down
        up, down = less | ~(eq | more) & full, more & eq
        if score <= most and (best is None or score < best[0]):
            best = score, at + 1
    return best


def _start(item: str, text: str, end: int, distance: int) -> int:
    """Where the passage that ends at ``end`` begins: the shortest one with the distance."""
    back = text[max(0, end - len(item) - distance) : end][::-1]
    found = myers_from_start(item[::-1], back, distance)
    return end - found


def myers_from_start(pattern: str, text: str, distance: int) -> int:
    """Length of the shortest prefix of ``text`` with this edit distance to ``pattern``; only a band is computed."""
    row = list(range(len(pattern) + 1))
    if row[-1] == distance:
        return 0
    for at, c in enumerate(text, 1):
        low, high = max(1, at - distance), min(len(pattern), at + distance)
        new = [distance + 1] * (len(pattern) + 1)
        if at <= distance:
            new[0] = at
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (pattern[j - 1] != c), row[j] + 1, new[j - 1] + 1)
        row = new
        if row[-1] <= distance:
            return at
    return len(text)


class Finder:
    """Finds items (number, normalised text) in texts; those under ``least_chars`` as whole lines or texts only."""

    def __init__(self, items: list[tuple[int, str]], edits: float, least_chars: int = 0):
        self.short = {t: n for n, t in items if len(t) < least_chars}
        items = [(n, t) for n, t in items if len(t) >= least_chars]
        self.items, self.budget = dict(items), {n: int(len(t) * edits) for n, t in items}
        self.automaton = ahocorasick.Automaton()
        spots: dict[str, list[tuple[int, int]]] = {}
        for number, text in items:
            for offset, piece in pieces(text, edits):
                spots.setdefault(piece, []).append((number, offset))
        for piece, where in spots.items():
            self.automaton.add_word(piece, (len(piece), where))
        if items:
            self.automaton.make_automaton()

    def find_all(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``find`` in the normalised text, and the short items that are a line, or all, of the text as it stands."""
        whole = normal(text)
        found = self.find(whole)
        if self.short and whole:
            places: dict[int, tuple[int, int]] = {}
            for at, line in [(0, whole), *lines(text)]:
                if line in self.short:
                    places.setdefault(self.short[line], (at, at + len(line)))
            found = sorted(found + [(n, 0, a, b) for n, (a, b) in places.items()])
        return found

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Per item found: number, distance, start and end of its closest passage, the first of equal ones."""
        if not self.items or not text:
            return []
        places: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                places.setdefault(number, set()).add(end + 1 - length - offset)
        found = []
        for number, starts in places.items():
            item, budget, best = self.items[number], self.budget[number], None
            exact = min((s for s in starts if s >= 0 and text.startswith(item, s)), default=None)
            if exact is not None:
                found.append((number, 0, exact, exact + len(item)))
                continue
            for low, high in _windows(sorted(starts), len(item), budget):
                low = max(low, 0)
                hit = myers(item, text[low:high], budget)
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], low + hit[1]
            if best:
                found.append((number, best[0], _start(item, text, best[1], best[0]), best[1]))
        return sorted(found)


def _windows(starts: list[int], length: int, budget: int) -> Iterator[tuple[int, int]]:
    """Passages around the places where an item could begin; overlapping ones as one."""
    low = high = None
    for start in starts:
        a, b = start - budget, start + length + budget
        if high is not None and a <= high:
            high = max(high, b)
            continue
        if high is not None:
            yield low, high
        low, high = a, b
    if high is not None:
        yield low, high


def leaks(
    documents: DataFrame, benchmark: DataFrame, folder: str, carry: list[str] | None = None, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, least_chars: int = LEAST_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``documents`` (the columns ``carry``, by default all) with ``leaks``: the items found in each text.

    Both sides are normalised (``normal``). An item leaks if some passage is within ``edits`` times its length of it, in
    edits of single characters; ``start`` and ``end`` are places in the normalised text. Items under ``least_chars``
    characters leak where they are a whole line or the whole text, at the first such place: within a line, a few
    common words are no evidence. Null items and those of white space are not searched. Items with equal texts each
    appear. A null text has no leaks; a column named ``leaks`` is replaced.

    Items are taken in blocks of about ``block_chars`` characters, so that a task's automaton stays small however
    many items there are. One block, as a rule, is one pass; several are written between passes.
    """
    spark = documents.sparkSession
    common.ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    items = items.where(F.length("text") > 0)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    keep = [c for c in (carry or documents.columns) if c != "leaks"]
    use = keep if text_col in keep else [*keep, text_col]
    docs = documents.select(*use, F.expr(f"CAST(NULL AS {LEAKS})").alias("leaks"))
    schema = docs.schema
    for block in range(blocks):
        some = [(r.item, normal(r.text)) for r in items.where(F.col("block") == block).collect()]
        finder = spark.sparkContext.broadcast(_grouped([x for x in some if x[1]]))
        docs = docs.mapInArrow(_pass(finder, use.index(text_col), len(use), edits, least_chars), schema)
        if blocks > 1:
            docs = common.written(docs, f"{folder}/block-{block}")
    return docs.select(*keep, F.coalesce("leaks", F.expr(f"CAST(array() AS {LEAKS})")).alias("leaks"))


def _grouped(items: list[tuple[int, str]]) -> list[tuple[str, list[int]]]:
    """Different texts with the ids that have them."""
    found: dict[str, list[int]] = {}
    for number, text in items:
        found.setdefault(text, []).append(number)
    return list(found.items())


def _pass(shared, text_at: int, leaks_at: int, edits: float, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        finder = Finder([(i, text) for i, (text, _) in enumerate(groups)], edits, least_chars)
        for batch in common.slices(batches):
            out = []
            before = batch.column(leaks_at)
            for text, old in zip(batch.column(text_at).to_pylist(), before.to_pylist()):
                new = [
                    {"item_id": item, "distance": d, "start": a, "end": b}
                    for i, d, a, b in finder.find_all(text) for item in groups[i][1]
                ]
                out.append((old or []) + new or None)
            columns = list(batch.columns)
            columns[leaks_at] = pa.array(out, before.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run
