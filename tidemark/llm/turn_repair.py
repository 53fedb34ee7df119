"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

The roles of a repaired conversation, by their initials, are a string of the grammar ``(s?(ua)+)?``. Of each length that
grammar has one string with a system turn and one without, and the shorter ones begin the longer ones. So turns are
aligned to both strings by Wagner and Fischer's table, whose last row has the cost for every length. Ukkonen's band
keeps the cells that an alignment no dearer than one found greedily can reach. Of the cheapest lengths the edits are
traced back, and the ASCII-least audit is taken.

Edits and their letters: Keep (K, cost 0), Rerole to user or assistant (R, 3), Delete (D, 4), Insert an empty user or
assistant turn (I, 3). Blank and duplicate turns must go; truncated ones that stay cost 3 more.

Long conversations are aligned in runs of rows: a run has a table for every role it can follow and end with, and tables
are chained by adding costs and joining audits. Of two audits of the same rows at the same cost neither begins with the
other, as the longer one would have more inserts and so cost more; so the least audits of runs make the least of all.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
RUN = 64  # rows aligned in one table
SEGMENT = 128  # rows of a conversation that a task holds
SEGMENT_BYTES = 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)  # what a conversation has come to: nothing yet, or the role of its last turn
BLANKS = " \t\n\x0b\x0c\r"
SHA = hashlib.sha256(b"").hexdigest()
# A turn's letter: d must go; s, u, a, x are initials (x any other), in capitals if it is truncated.
Best = tuple[int, str]


def align(symbols: str, target: str, spare: int) -> dict[int, Best]:
    """The cheapest (cost, audit) by length, for lengths of ``target`` from 1 (2 with a system turn) that are in the band.

    ``symbols`` has no turn that must go. ``spare`` is how far a length may be above the greedy alignment's cost.
    """
    m, leads = len(symbols), target[0] == "s"
    fixed = [TRUNCATED if c.isupper() else 0 for c in symbols]
    kinds = symbols.lower()
    skipped = kinds.find("s") if leads else 0
    if skipped < 0:
        return {}
    # The greedy alignment keeps or reroles every turn, after those before the system turn are deleted.
    most = skipped * DELETE + spare + sum(
        fixed[i] + (0 if kinds[i] == target[i - skipped] else REROLE) for i in range(skipped, m)
    )
    below, above = most // DELETE, most // INSERT
    table: list[dict[int, int]] = [{} for _ in range(m + 1)]
    for i in range(m + 1):
        row, last = table[i], table[i - 1] if i else {}
        for j in range(max(0, i - below), min(len(target), i + above) + 1):
            costs = [0] if not i and not j else []
            if j in last:
                costs.append(last[j] + DELETE)
            if j - 1 in last:
                step = _step(kinds[i - 1], target[j - 1])
                if step is not None:
                    costs.append(last[j - 1] + step + fixed[i - 1])
            if j - 1 in row and target[j - 1] != "s":
                costs.append(row[j - 1] + INSERT)
            if costs and min(costs) <= most:
                row[j] = min(costs)
    return {
        j: (cost, _backtrace(kinds, fixed, target, table, j)) for j, cost in table[m].items() if j > (1 if leads else 0)
    }


def _step(kind: str, role: str) -> int | None:
    if kind == role:
        return 0
    return None if role == "s" else REROLE


def _backtrace(kinds: str, fixed: list[int], target: str, table: list[dict[int, int]], length: int) -> str:
    """The ASCII-least of the audits with the least cost: first the cells on any such path, then the least way."""
    on = {(len(kinds), length)}
    todo = [(len(kinds), length)]
    steps: dict[tuple[int, int], list[tuple[str, tuple[int, int]]]] = {}
    while todo:
        i, j = todo.pop()
        cost = table[i][j]
        before = []
        if i and table[i - 1].get(j) == cost - DELETE:
            before.append(("D", (i - 1, j)))
        if j and target[j - 1] != "s" and table[i].get(j - 1) == cost - INSERT:
            before.append(("I", (i, j - 1)))
        if i and j and (step := _step(kinds[i - 1], target[j - 1])) is not None:
            if table[i - 1].get(j - 1) == cost - step - fixed[i - 1]:
                before.append(("R" if step else "K", (i - 1, j - 1)))
        for letter, cell in before:
            steps.setdefault(cell, []).append((letter, (i, j)))
            if cell not in on:
                on.add(cell)
                todo.append(cell)
    at, audit = (0, 0), []
    while at != (len(kinds), length):
        letter, at = min(steps[at])
        audit.append(letter)
    return "".join(audit)


@lru_cache(maxsize=1 << 15)
def run_table(symbols: str) -> tuple[tuple[Best | None, ...], ...]:
    """The cheapest (cost, audit) of a run of turns for each state before and after it."""
    core = symbols.replace("d", "")
    m, gone = len(core), DELETE * (len(symbols) - len(core))
    alternate = "ua" * (m + 2)
    # A length more than the greedy one, or two, is needed for the other role at the end.
    by_user = align(core, alternate, 2 * INSERT)
    by_assistant = align(core, alternate[1:], 2 * INSERT)
    by_system = align(core, "s" + alternate, 2 * INSERT)
    found: dict[tuple[int, int], list[Best]] = {(s, s): [(m * DELETE, "D" * m)] for s in range(4)}

    def ends(before: int, after: int, lengths: dict[int, Best], odd: int) -> None:
        found.setdefault((before, after), []).extend(best for j, best in lengths.items() if j % 2 == odd)

    for before in (START, SYSTEM, ASSISTANT):
        ends(before, USER, by_user, 1)
        ends(before, ASSISTANT, by_user, 0)
    ends(USER, ASSISTANT, by_assistant, 1)
    ends(USER, USER, by_assistant, 0)
    ends(START, USER, by_system, 0)
    ends(START, ASSISTANT, by_system, 1)
    found[START, SYSTEM] = [
        ((m - 1) * DELETE + (TRUNCATED if c == "S" else 0), "D" * i + "K" + "D" * (m - 1 - i))
        for i, c in enumerate(core) if c in "sS"
    ]
    best = {
        pair: (cost + gone, _with_deleted(symbols, audit))
        for pair, some in found.items() if some for cost, audit in [min(some)]
    }
    return tuple(tuple(best.get((p, q)) for q in range(4)) for p in range(4))


def _with_deleted(symbols: str, audit: str) -> str:
    """An audit of the turns that may stay, with those that must go: each goes as early as it can, as D is least."""
    out, at = [], 0
    for letter in audit:
        while at < len(symbols) and symbols[at] == "d":
            out.append("D")
            at += 1
        out.append(letter)
        at += letter != "I"
    return "".join(out) + "D" * (len(symbols) - at)


def chained(symbols: str) -> list[list[Best | None]]:
    """The table of many turns, from those of runs of them."""
    whole: list[list[Best | None]] = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
    for at in range(0, len(symbols), RUN):
        run = run_table(symbols[at : at + RUN])
        whole = [[
            min((
                (row[mid][0] + run[mid][q][0], row[mid][1] + run[mid][q][1])
                for mid in range(4) if row[mid] is not None and run[mid][q] is not None
            ), default=None) for q in range(4)
        ] for row in whole]
    return whole


def ended(table: list[Best | None]) -> Best:
    """The best end of a conversation: without turns or after an assistant's; one more run inserts what is missing."""
    last = run_table("")
    return min(
        (best[0] + last[q][end][0], best[1] + last[q][end][1])
        for q, best in enumerate(table) if best is not None for end in (START, ASSISTANT) if last[q][end] is not None
    )


def repaired(state: int, audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """Role and text of the turns that an audit leaves, after a turn of the given state."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        due = ASSISTANT if state == USER else USER
        role, text = ("user", "assistant")[due == ASSISTANT], ""
        if letter != "I":
            role, text, at = roles[at] if letter == "K" else role, texts[at], at + 1
        state = SYSTEM if letter == "K" and state == START and role[:1] == "s" else due
        out.append((role, text))
    return out


def _lines(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone, copy``: faults by crc32(`conv_id:turn`) % 20; dropped rows are marked as gone.

    Null roles and texts become one space, as do null ids and turns in the text of which the crc32 is taken.
    """
    space = F.lit(" ")
    at = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    fault = F.crc32(at.cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), fault.alias("fault"),
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault <= 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"))


def repair(rows: DataFrame, folder: str, segment: int = SEGMENT, keep_turns: bool = False) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (``conv_id, turn, role, text, gone``): faults, cost and audit of the repair.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` and, with
    ``keep_turns``, ``turns``: role and text of the repaired turns (null for a conversation of more than ``segment``
    rows, whose turns ``repaired`` gives). Rows that are ``gone`` only name their conversation. Roles and texts are not
    null. Rows are taken by turn, nulls first, equal turns by role and text; repeated rows are duplicates. A null id is
    a conversation. A conversation without rows has zeros, an empty audit and the hash of an empty text.

    Rows are sorted over the whole cluster by conversation and turn. A task passes over its part and keeps ``segment``
    rows at most: conversations that lie within are repaired there. Those that are longer or reach over an end of
    the part leave a line per segment, with its tables. One pass over these lines chains the tables, and hashes the turns,
    which are one text for the hash: that pass is by one task for a conversation.
    """
    spark = rows.sparkSession
    common.ship(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select(
        "conv_id", "turn", "role", "text", "gone", (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), F.md5(F.encode("text", "utf-8")).alias("digest"),
    )
    # Texts said again at another turn; rows that repeat each other within a turn meet when they are sorted.
    said = rows.where("NOT gone AND NOT blank").groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_if(F.col("turn").isNull()).alias("nulls")
    )
    said = said.where("first < last OR (nulls > 0 AND first IS NOT NULL)").select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first",
        "nulls", F.lit(True).alias("again"),
    )
    same = F.expr("conv_id <=> _conv AND role = _role AND digest = _digest")
    later = F.expr("again AND turn IS NOT NULL AND (nulls > 0 OR turn > first)")
    flagged = rows.join(said, same, "left").select(
        "conv_id", "turn", "role", "text", "gone", "blank", "cut", F.coalesce(later, F.lit(False)).alias("later")
    )
    head = F.substring("text", 1, 64)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = flagged.repartitionByRange(*order, head).sortWithinPartitions(*order, "text")
    dealt = dealt.select("conv_id", "turn", "role", "text", "gone", "blank", "cut", "later", F.spark_partition_id().alias("part"))
    ends = "illegal long, blank long, duplicate long, truncated long, n long, first string, last string, low long, high long, days long"
    segments = common.written(
        dealt.mapInArrow(
            lambda batches: _segments(batches, segment, keep_turns),
            f"conv_id {kind}, part int, place int, whole boolean, {ends}, cost long, audit string, sha string, "
            "costs array<long>, audits array<string>, roles array<string>, texts array<string>",
        ),
        f"{folder}/segments", "zstd",
    )
    done = segments.where("whole").select("conv_id", *_measures(), "cost", "audit", "sha", "roles", "texts")
    open_rows = segments.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    names = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string"
    rest = open_rows.mapInArrow(
        lambda batches: _merged(batches, segment if keep_turns else 0),
        f"conv_id {kind}, {names}, roles array<string>, texts array<string>",
    )
    found = done.unionByName(rest).withColumnRenamed("sha", "repaired_sha256")
    if keep_turns:
        found = found.withColumn("turns", F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text")))
    return found.drop("roles", "texts")


def _measures() -> list[Column]:
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("days"), F.lit(0)).cast("long").alias("gaps")
    return [gaps, *(F.col(c) for c in ("blank", "duplicate", "truncated", "illegal"))]


class _Segment:
    """Rows of one conversation in order, without gone ones."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.turns: list[int | None] = []
        self.bytes = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, role: str, text: str, blank: bool, cut: bool, again: bool) -> None:
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if blank or again:
            self.blank += blank
            self.duplicate += not blank
            kind = "d"
        elif cut:
            self.truncated += 1
            kind = kind.upper()
        self.symbols.append(kind)
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.bytes += len(text)

    def measured(self) -> dict:
        initials = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        return {
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "n": len(initials),
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "days": len(set(turns)),
        }


def _segments(batches: Iterator[pa.RecordBatch], most: int, keep_turns: bool) -> Iterator[pa.RecordBatch]:
    """Lines of the conversations in a sorted part. The first and the last may go on in other parts."""
    out, current, held = [], None, _Segment()
    place, is_first, before = 0, True, None
    schema = None

    def line(whole: bool) -> dict:
        row = {"conv_id": current[0], "part": part, "place": place, "whole": whole, **held.measured()}
        symbols = "".join(held.symbols)
        if whole:
            cost, audit = ended(chained(symbols)[START])
            turns = repaired(START, audit, held.roles, held.texts)
            row |= {"cost": cost, "audit": audit, "sha": hashlib.sha256(_lines(turns).encode()).hexdigest()}
            if keep_turns:
                row |= {"roles": [r for r, _ in turns], "texts": [t for _, t in turns]}
            return row
        cells = [best for some in chained(symbols) for best in some]
        row |= {"costs": [b and b[0] for b in cells], "audits": [b and b[1] for b in cells]}
        return row | {"roles": held.roles, "texts": held.texts}

    part = 0
    for batch in common.slices(batches, 512):
        schema = schema or _line_schema(batch.schema.field("conv_id").type)
        for conv, turn, role, text, gone, blank, cut, later, part_now in zip(*(c.to_pylist() for c in batch.columns)):
            part = part_now
            if current is None or current[0] != conv:
                if current is not None:
                    out.append(line(not is_first and place == 0))
                    is_first = False
                current, held, place, before = (conv,), _Segment(), 0, None
            if len(held.texts) >= most or held.bytes > SEGMENT_BYTES:
                out.append(line(False))
                held, place = _Segment(), place + 1
            if not gone:
                now = (turn, role, text)
                held.add(turn, role, text, blank, cut, later or now == before)
                before = now
            if len(out) >= 512 or sum(len(r.get("texts") or ()) for r in out[-1:]) >= most:
                yield _batch(out, schema)
                out = []
    if current is not None:
        out.append(line(False))
    if out:
        yield _batch(out, schema)


def _line_schema(id_type: pa.DataType) -> pa.Schema:
    longs = ["illegal", "blank", "duplicate", "truncated", "n"]
    return pa.schema([
        ("conv_id", id_type), ("part", pa.int32()), ("place", pa.int32()), ("whole", pa.bool_()),
        *((c, pa.int64()) for c in longs), ("first", pa.string()), ("last", pa.string()),
        *((c, pa.int64()) for c in ("low", "high", "days", "cost")), ("audit", pa.string()), ("sha", pa.string()),
        ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema
    )


class _Chain:
    """A conversation read segment by segment: for each state the cheapest way there, and the hash of its turns.

    Its rows are kept as long as they are no more than ``most``.
    """

    def __init__(self, most: int) -> None:
        self.most, self.n, self.roles, self.texts = most, 0, [], []
        self.ways = {START: (0, "", hashlib.sha256())}
        self.said = ""  # audit that all ways share
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "days"), 0)
        self.low = self.high = self.last = None

    def add(self, row: dict) -> None:
        self.n += row["n"]
        if self.n <= self.most:
            self.roles += row["roles"]
            self.texts += row["texts"]
        else:
            self.roles, self.texts = [], []
        for c in self.sums:
            self.sums[c] += row[c]
        if row["low"] is not None:
            self.sums["days"] -= self.high == row["low"]
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        if row["n"]:
            self.sums["illegal"] += self.last is not None and self.last + row["first"] not in LEGAL
            self.last = row["last"]
        ways = {}
        for after in range(4):
            best = None
            for before, (cost, audit, sha) in self.ways.items():
                at = 4 * before + after
                if row["costs"][at] is not None:
                    one = (cost + row["costs"][at], audit + row["audits"][at], before, row["audits"][at])
                    best = one if best is None else min(best, one)
            if best is not None:
                cost, audit, before, edits = best
                ways[after] = (cost, audit, self._hashed(before, edits, row["roles"], row["texts"]))
        shared = len(os.path.commonprefix([audit for _, audit, _ in ways.values()]))
        self.said += next(iter(ways.values()))[1][:shared]
        self.ways = {q: (cost, audit[shared:], sha) for q, (cost, audit, sha) in ways.items()}

    def _hashed(self, before: int, edits: str, roles: list[str], texts: list[str]):
        sha = self.ways[before][2].copy()
        turns = repaired(before, edits, roles, texts)
        if turns:
            sha.update((("\n" if before != START else "") + _lines(turns)).encode())
        return sha

    def result(self, conv) -> dict:
        last = run_table("")
        cost, audit, before, edits = min(
            (cost + last[q][end][0], audit + last[q][end][1], q, last[q][end][1])
            for q, (cost, audit, _) in self.ways.items() for end in (START, ASSISTANT) if last[q][end] is not None
        )
        sums = dict(self.sums)
        days = sums.pop("days")
        gaps = 0 if self.low is None else self.high - self.low + 1 - days
        sha = self._hashed(before, edits, [], []).hexdigest()
        found = {"conv_id": conv, "gaps": gaps, **sums, "cost": cost, "audit": self.said + audit, "sha": sha}
        if self.n <= self.most:
            turns = repaired(START, found["audit"], self.roles, self.texts)
            found |= {"roles": [r for r, _ in turns], "texts": [t for _, t in turns]}
        return found


def _merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Conversations from the lines of their segments, in order; with their turns if they have up to ``most`` rows."""
    current, chain, out, schema = None, None, [], None
    for batch in common.slices(batches, 4):
        schema = schema or pa.schema([
            ("conv_id", batch.schema.field("conv_id").type),
            *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            ("audit", pa.string()), ("sha", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
        ])
        for row in batch.to_pylist():
            if current is None or current[0] != row["conv_id"]:
                if current is not None:
                    out.append(chain.result(current[0]))
                current, chain = (row["conv_id"],), _Chain(most)
            chain.add(row)
        if len(out) >= 512:
            yield _batch(out, schema)
            out = []
    if current is not None:
        out.append(chain.result(current[0]))
    if out:
        yield _batch(out, schema)
