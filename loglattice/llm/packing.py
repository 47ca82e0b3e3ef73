"""Packing whole documents into fixed-length training sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder.  The remainders' length histogram (``BINS`` classes, whatever
the corpus holds) is a cutting-stock problem: a linear program over patterns, whose columns a knapsack dynamic program
prices.  Rounded patterns, and best-fit-decreasing ones for what rounding leaves, say which class sits where in which
sequence; pieces are ranked within their class and take the places in rank order.

Only the histogram reaches the driver.  Ranks come from per-task counts, so a class of any size is never sorted or
gathered in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm._store import stored
from loglattice.llm._tokens import token_batches

BINS = 256
END_ID = 1


def best_pattern(values: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The most valuable pattern: an unbounded knapsack where item i (from 1) has size i and worth values[i-1]."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for at in range(1, room + 1):
        worth = values[:at] + best[at - 1 :: -1][:at]
        pick = int(worth.argmax())
        best[at], last[at] = worth[pick], pick + 1
        if best[at - 1] >= best[at]:
            best[at], last[at] = best[at - 1], 0
    pattern: dict[int, int] = {}
    at = room
    while at > 0:
        if size := int(last[at]):
            pattern[size] = pattern.get(size, 0) + 1
            at -= size
        else:
            at -= 1
    return float(best[room]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; small enough here to need no threaded library."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        busy = np.flatnonzero(factors)
        work[busy] -= factors[busy, None] * work[k]
    return work[:, n:]


def fullest(left: np.ndarray, room: int, first: int) -> dict[int, int]:
    """A pattern with one item of size ``first`` that fills ``room`` as far as the items left allow: bounded subset sum."""
    goal = room - first
    reach = [(1, 0, 0)]  # sums reached as a bit set, after which item
    mask = (1 << (goal + 1)) - 1
    for size in range(min(first, goal), 0, -1):
        have = int(left[size - 1]) - (size == first)
        bits = reach[-1][0]
        for _ in range(min(have, goal // size)):
            more = (bits | bits << size) & mask
            if more == bits:
                break
            reach.append((more, size, 1))
            bits = more
        if bits >> goal & 1:
            break
    pattern, at = {first: 1}, reach[-1][0].bit_length() - 1
    for k in range(len(reach) - 1, 0, -1):
        size = reach[k][1]
        if not reach[k - 1][0] >> at & 1:
            pattern[size] = pattern.get(size, 0) + 1
            at -= size
    return pattern


def solve(demand: np.ndarray, rounds: int = 6000) -> list[tuple[dict[int, int], int]]:
    """Patterns over sizes 1..len(demand) with how often each is used; together they hold exactly the demand.

    Column generation ends when no pattern is worth more than a sequence, or after ``rounds`` columns, about twenty times
    what 256 classes take; its plan then is not the best, but holds the demand all the same.
    """
    room = len(demand)
    sizes = [i + 1 for i in range(room) if demand[i]]
    used: list[tuple[dict[int, int], int]] = []
    left = demand.astype(np.int64).copy()
    if sizes:
        row = {s: k for k, s in enumerate(sizes)}
        need = np.array([demand[s - 1] for s in sizes], float)
        basis = [{s: room // s} for s in sizes]
        inverse = np.diag([1.0 / (room // s) for s in sizes])
        amount = inverse @ need
        for turn in range(rounds):
            if turn % 200 == 199:  # against drift
                matrix = np.zeros((len(sizes), len(sizes)))
                for k, pattern in enumerate(basis):
                    for s, n in pattern.items():
                        matrix[row[s], k] = n
                inverse = inverted(matrix)
                amount = inverse @ need
            price = inverse.sum(0)
            values = np.full(room, -1.0)
            values[np.array(sizes) - 1] = price
            worth, pattern = best_pattern(values, room)
            if worth <= 1 + 1e-7:
                break
            column = np.zeros(len(sizes))
            for s, n in pattern.items():
                column[row[s]] = n
            step = inverse @ column
            rising = step > 1e-9
            if not rising.any():
                break
            ratio = np.where(rising, np.maximum(amount, 0) / np.where(rising, step, 1), np.inf)
            out = int(ratio.argmin())
            amount = amount - ratio[out] * step
            amount[out] = ratio[out]
            basis[out] = pattern
            inverse[out] /= step[out]
            others = np.arange(len(sizes)) != out
            inverse[others] -= np.outer(step[others], inverse[out])
        for pattern, times in zip(basis, np.floor(amount + 1e-6).astype(np.int64), strict=True):
            times = min([int(times), *(int(left[s - 1]) // n for s, n in pattern.items())])
            if times > 0:
                used.append((pattern, times))
                for s, n in pattern.items():
                    left[s - 1] -= n * times
    # what rounding leaves, at most about one pattern a class: fill one sequence after the other as full as it gets
    while left.any():
        largest = int(left.nonzero()[0][-1]) + 1
        pattern = fullest(left, room, largest)
        times = min(int(left[s - 1]) // n for s, n in pattern.items())
        used.append((pattern, times))
        for s, n in pattern.items():
            left[s - 1] -= n * times
    return used


def places(plan: list[tuple[dict[int, int], int]]) -> tuple[dict[int, tuple], int]:
    """class -> (first rank, first sequence, slot) of its stretches, ranks ascending; and the number of sequences."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        slot = 0
        for size in sorted(pattern, reverse=True):
            for _ in range(pattern[size]):
                first = ranks.get(size, 0)
                out.setdefault(size, []).append((first, base, slot))
                ranks[size] = first + times
                slot += 1
        base += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in out.items()}, base


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, class int, rank long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, room: int, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its rank among its task's pieces of the same length class."""
    grain = -(-room // BINS)

    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for ids, tokens in token_batches(tokenizer_path, batch.column(0), batch.column(1)):
                rows = [[] for _ in range(8)]
                for doc, own in zip(ids, tokens, strict=True):
                    whole = np.append(own, end_id).astype("<u4")
                    for start in range(0, len(whole), room):
                        part = whole[start : start + room]
                        kind = -(-len(part) // grain)
                        for column, value in zip(rows, (doc, start, len(part), zlib.crc32(part.tobytes()), len(whole), task, kind, int(seen[kind])), strict=True):
                            column.append(value)
                        seen[kind] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (5, 6) else pa.int64()) for i, c in enumerate(rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "class", "rank"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, room: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents placed in sequences of at most ``room`` tokens.

    docs(doc_id, text, ...): other columns are ignored.  Every row is a document, repeated rows too; a null or empty
    text is the end id alone; a long text is cut into full sequences and one remainder; ties in length keep task order;
    an empty table gives no rows.  Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding: every
    id of every document lies in exactly one piece, offsets in a sequence are gapless from 0, and padding is what lies
    behind the sequence's last piece (0 in its other rows); none at a power of two.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_path, room, end_id), "pieces")
    counts = pieces.groupBy("task", "class").agg(F.count("*").alias("n"))
    histogram = np.zeros(BINS, np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most BINS rows
        histogram[row["class"] - 1] = row["n"]
    slots, _ = places(solve(histogram))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                mine = np.flatnonzero(kind == k)
                first, base, at = slots[int(k)]
                pick = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], slot[mine] = base[pick] + rank[mine] - first[pick], at[pick]
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(slot)], [*keep, "sequence_id", "slot"])

    placed = pieces.join(bases, ["task", "class"]).mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    last = F.lead("slot").over(inside).isNull()
    power = total.bitwiseAND(total - 1) == 0
    placed = placed.withColumns({"offset": offset, "padding": F.when(last & ~power, room - total).otherwise(F.lit(0)).cast("long")})
    return placed.drop("slot")
