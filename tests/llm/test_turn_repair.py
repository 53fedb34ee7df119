"""Repair of conversations against a search for the cheapest edits over all of a conversation at once."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import common, queries, turn_repair

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    """Rows (conv_id, turn, role, text) as the contract damages them; every conversation is there."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(name.encode()) % 20
        some = out[conv]
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fault == 4:
            role = "user"
        some += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(kinds):
    """Least (cost, audit) by a search over (row, role of the last turn kept), nearest first."""
    seen, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(kinds) and last in ("", "a"):
            return cost, audit
        if (i, last) in seen:
            continue
        seen.add((i, last))
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[last]))
        if i < len(kinds):
            must_go, cut, initial = kinds[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if not must_go:
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, NEXT[last]))
                if initial == NEXT[last] or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, initial))


def plain(conversations):
    out = []
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        blank = duplicate = truncated = 0
        seen, kinds = set(), []
        for _, role, text in rows:
            bare = text.rstrip(BLANKS)
            one = (not bare, bool(bare) and (role, text) in seen)
            cut = bool(bare) and not one[1] and bare[-1] not in ".!?"
            seen.add((role, text))
            blank, duplicate, truncated = blank + one[0], duplicate + one[1], truncated + cut
            kinds.append((any(one), cut, role[:1]))
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(kinds)
        lines, at, last = [], 0, ""
        for letter in audit:
            if letter != "D":
                role = rows[at][1] if letter == "K" else {"u": "user", "a": "assistant"}[NEXT[last]]
                last = role[:1]
                lines.append(f"{role}:{'' if letter == 'I' else rows[at][2]}")
            at += letter != "I"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn int, role string, text string, audit string, cost int")
    return turn_repair.repair(turn_repair.damaged(df.repartition(3)), common.work_dir(spark, "t"), **options)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_turn_repair(spark, SF)
    assert got(found) == plain(damage(rows))
    assert {c: t for c, t in found.dtypes if c not in ("conv_id", "audit", "repaired_sha256")} == dict.fromkeys(COLUMNS[1:7], "bigint")


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_random_conversations_in_segments(spark, segment):
    """Any roles, ties in the order, repeated rows, null turns, roles and texts, and one hot conversation."""
    rng = random.Random(segment)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "user", "assistant"]
    texts = ["Yes.", "no", "", " \t\x0b\r", None, "Why?", "Ünd!", "a\nb.", "end . ", "x"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(300 if conv == 7 else rng.randint(1, 14)):
            turn = None if rng.random() < 0.05 else turn + rng.randint(0, 2) * (rng.random() < 0.2)
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{conv} {turn} {rng.random()}."))
    rows += rows[:20]
    assert got(run(spark, rows, segment=segment)) == plain(damage(rows))


def test_edges(spark):
    """Empty tables, conversations all of whose rows are dropped, null turns only, long texts."""
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:5".encode()) % 20 == 0)
    rows = [(dropped, 5, "user", "Hi."), (2000, None, "user", "a."), (2000, None, None, None), (2001, 1, "user", "w " * 2_000_000 + ".")]
    found = {r[0]: r for r in got(run(spark, rows))}
    assert sorted(found.values(), key=str) == plain(damage(rows))
    assert found[dropped][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(run(spark, rows).where("false")) == []
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert got(turn_repair.repair(turn_repair.damaged(empty), common.work_dir(spark, "t"))) == []


def test_bands_and_chains_find_the_least():
    rng = random.Random(5)
    for _ in range(3000):
        symbols = "".join(rng.choice("suaxSUAXdduauaua") for _ in range(rng.randint(0, 12)))
        kinds = [(c == "d", c.isupper(), c.lower()) for c in symbols]
        table = turn_repair.chained(symbols)
        assert turn_repair.ended(table[turn_repair.START]) == cheapest(kinds)


def test_turns_are_returned(spark):
    rows = [(3001, t, r, x) for t, r, x in ((1, "system", "S."), (2, "user", "U."), (3, "user", "V."), (4, "assistant", "A."))]
    found = run(spark, rows, keep_turns=True).collect()[0]
    text = "\n".join(f"{t.role}:{t.text}" for t in found.turns)
    assert hashlib.sha256(text.encode()).hexdigest() == found.repaired_sha256
    assert found.turns[0].role in ("system", "user")
