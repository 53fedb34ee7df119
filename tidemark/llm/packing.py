"""Best-two-fit packing of token pieces into sequences.

Only lengths decide how pieces are packed, and a length is at most the capacity. So the plan is made from the
histogram of lengths, which has at most ``capacity`` rows whatever the input: bins that use the same lengths are one
line of the plan with a multiplicity. Pieces then take their places in the plan by their number among all pieces of
the same length, which needs counts per task and length but never the pieces of one length in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common
from tidemark.llm.token_ids import encoder

CAPACITY = 4096


def pieces_of(
    documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids`` (unsigned 32-bit, little-endian).

    A document is its ids (null text as empty) and ``end_id``; only documents over ``capacity`` are cut, the last
    piece may be shorter. Repeated rows are documents of their own; a null id stays null.
    """
    common.ship(documents.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in common.slices(batches):
            keys, piece, start, length, ids = [], [], [], [], []
            for key, found in zip(batch.column(0).to_pylist(), enc.encode(common.texts_of(batch.column(1)))):
                whole = np.append(found, end_id).astype("<u4")
                for number, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    keys.append(key)
                    piece.append(number)
                    start.append(at)
                    length.append(len(part))
                    ids.append(part.tobytes())
            yield pa.record_batch([
                pa.array(keys, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
            ], ["doc_id", "piece", "start", "length", "ids"])

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins for the lengths of ``histogram`` (length: count) as (multiplicity, lengths in a bin).

    Each bin takes the longest piece left and is filled greedily by the longest that fits. Then its smallest piece
    goes back if two unpacked pieces fill the gap with it more tightly. The same bin is repeated while its lengths
    last. Small pieces used early can be missed later, so the plan without replacements is kept where it has fewer
    bins. A length under 1 or over ``capacity`` is an error.
    """
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    plans = [_fill(histogram, capacity, replace) for replace in (True, False)]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def _fill(histogram: dict[int, int], capacity: int, replace: bool) -> list[tuple[int, list[int]]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    plan = []
    while left.any():
        # The longest length available up to each size; 0 where there is none.
        fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        bin_, gap = [], capacity
        spare: dict[int, int] = {}

        def longest(size: int, fits=fits, spare=spare) -> int:
            at = int(fits[size])
            while at and spare.get(at, left[at]) == 0:
                at = int(fits[at - 1])
            return at

        while gap and (best := longest(gap)):
            copies = min(gap // best, int(spare.get(best, left[best])))
            bin_ += [best] * copies
            spare[best] = int(spare.get(best, left[best])) - copies
            gap -= best * copies
        if replace and gap and len(bin_) > 1:
            small = bin_[-1]
            pair = _two(left, spare, small + gap, small, lengths)
            if pair:
                bin_.pop()
                spare[small] += 1
                for x in pair:
                    spare[x] = int(spare.get(x, left[x])) - 1
                bin_ += pair
        used, need = np.unique(bin_, return_counts=True)
        times = int((left[used] // need).min())
        left[used] -= need * times
        plan.append((times, sorted(bin_, reverse=True)))
    return plan


def _two(left, spare, room: int, over: int, lengths) -> list[int] | None:
    """Two unpacked lengths whose sum is the largest up to ``room`` and more than ``over``."""
    free = left[: room + 1].copy()
    for length, n in spare.items():
        if length <= room:
            free[length] = n
    fits = np.maximum.accumulate(np.where(free > 0, lengths[: room + 1], 0))
    one = np.flatnonzero(free > 0)
    one = one[(one >= 1) & (one < room)]
    if not len(one):
        return None
    two = fits[room - one]
    # Where both are the same length, it takes two of them; else the next shorter one.
    same = (two == one) & (free[one] < 2)
    two = np.where(same, np.where(one > 0, fits[np.maximum(one - 1, 0)], 0), two)
    total = np.where(two > 0, one + two, 0)
    best = int(total.argmax())
    return [int(one[best]), int(two[best])] if total[best] > over else None


def pack(pieces: DataFrame, folder: str, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: as few sequences as the method finds, without gaps.

    Any table with a length column; its other columns come along, also such named ``sequence_id`` or ``offset``,
    which are replaced. Rows are numbered per task and length when written to ``folder``; only those counts meet in
    a window per length, and only the plan, at most one line per bin form, goes to the driver and the tasks.
    """
    spark = pieces.sparkSession
    common.ship(spark)
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*keep)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        at = keep.index(length)
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(sizes, kind="stable")
            values, first, n = np.unique(sizes[order], return_index=True, return_counts=True)
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(sizes)) - np.repeat(first, n) + np.repeat(seen[values], n)
            seen[values] += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(rank)],
                [*batch.schema.names, "_part", "_rank"],
            )

    schema = T.StructType([*rows.schema, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())])
    numbered = common.written(rows.mapInArrow(number, schema), f"{folder}/numbered")
    counts = numbered.groupBy(F.col(length).alias("_length"), "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.written(
        counts.select("_length", "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
        f"{folder}/counts",
    )
    histogram = {r["_length"]: r["n"] for r in counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    slots = _slots(plan_bins(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(keep.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes):
                mine = sizes == size
                first, start, offsets, copies = slots[int(size)]
                line = np.searchsorted(first, rank[mine], side="right") - 1
                inside = rank[mine] - first[line]
                sequence[mine] = start[line] + inside // copies[line]
                offset[mine] = offsets[line] + (inside % copies[line]) * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(sequence), pa.array(offset)],
                [*keep, "sequence_id", "offset"],
            )

    starts = counts.select("_length", F.col("_part").alias("_of"), "_before")
    ranked = numbered.join(starts, (F.col(length) == F.col("_length")) & (F.col("_part") == F.col("_of")))
    ranked = ranked.select(*keep, (F.col("_before") + F.col("_rank")).alias("_rank"))
    places = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType([*rows.schema, *places]))


def _slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, by lines of the plan: first piece number, first sequence, offset in the bin, copies in a bin."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, bin_ in plan:
        offset = 0
        for size in sorted(set(bin_), reverse=True):
            copies = bin_.count(size)
            found.setdefault(size, []).append((taken.get(size, 0), sequence, offset, copies))
            taken[size] = taken.get(size, 0) + copies * times
            offset += copies * size
        sequence += times
    return {size: tuple(np.array(column, np.int64) for column in zip(*lines)) for size, lines in found.items()}


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """The sequences themselves: ``sequence_id`` and its ids end to end, from packed pieces that carry them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))  # at most `capacity` pieces
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    hexed = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    return joined.select("sequence_id", F.unhex(hexed).alias("ids"))
