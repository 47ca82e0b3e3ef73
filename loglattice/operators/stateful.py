"""Path-dependent operators: one pure step function each, run over a key's rows in order and in constant memory.

What a row does depends on which earlier rows were accepted, so a window over raw rows cannot express them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def dedup_steps(rows: Iterable[tuple[int, int]]) -> Iterator[str]:
    """(base sequence, count) in arrival order -> append, cached (an exact retry of the last) or out_of_order."""
    last = None
    for sequence, count in rows:
        if last is None or sequence == last[0] + last[1]:
            last = (sequence, count)
            yield "append"
        else:
            yield "cached" if (sequence, count) == last else "out_of_order"


def bucket_steps(rows: Iterable[tuple[int, float]], rate: float) -> Iterator[int]:
    """(ms, need) -> 0 if granted, else the milliseconds to wait; the bucket holds one second's rate and starts full."""
    tokens, before = rate, None
    for ms, need in rows:
        if before is not None:
            tokens = min(rate, tokens + rate * max(0, ms - before) / 1000)
        before = ms
        if need <= tokens:
            tokens -= need
            yield 0
        else:
            yield max(1, -int(-((need - tokens) / rate * 1000) // 1))


def seal_steps(rows: Iterable[tuple[int, int]], most: int, linger: int) -> Iterator[int]:
    """(ms, size) -> batch number; a batch seals after the row that fills it, or before one that comes too late."""
    number, total, began = 0, 0, None
    for ms, size in rows:
        if began is not None and ms - began >= linger:
            number, total, began = number + 1, 0, None
        began = ms if began is None else began
        total += size
        yield number
        if total >= most:
            number, total, began = number + 1, 0, None


def roll_steps(sizes: Iterable[int], most: int) -> Iterator[int]:
    """Segment number of each batch; a segment rolls after the batch that reaches the size."""
    number, total = 0, 0
    for size in sizes:
        total += size
        yield number
        if total >= most:
            number, total = number + 1, 0


_MOVES = {("EMPTY", "add"): "ONGOING", ("ONGOING", "add"): "ONGOING", ("ONGOING", "commit"): "PREPARE_COMMIT", ("ONGOING", "abort"): "PREPARE_ABORT", ("PREPARE_COMMIT", "markers"): "COMPLETE_COMMIT", ("PREPARE_ABORT", "markers"): "COMPLETE_ABORT", ("COMPLETE_COMMIT", "add"): "ONGOING", ("COMPLETE_ABORT", "add"): "ONGOING"}
_SAME = {("PREPARE_COMMIT", "commit"), ("COMPLETE_COMMIT", "commit"), ("PREPARE_ABORT", "abort"), ("COMPLETE_ABORT", "abort")}


def txn_steps(rows: Iterable[tuple[str, int]]) -> Iterator[tuple[str, str]]:
    """(event, epoch) -> (state behind it, outcome); older epochs are fenced, a newer one aborts what is open."""
    state, epoch = "EMPTY", 0
    for event, own in rows:
        if own < epoch:
            yield (state, "fenced")
        elif event == "init":
            state, epoch = ("PREPARE_ABORT" if state == "ONGOING" else state), own + 1
            yield (state, "ok")
        elif (state, event) in _MOVES:
            state, epoch = _MOVES[state, event], own
            yield (state, "ok")
        else:
            yield (state, "retry" if (state, event) in _SAME else "invalid")


def cas_steps(rows: Iterable[tuple[int, int, int]]) -> Iterator[bool]:
    """(prior epoch, new epoch, value) -> applied; a change whose prior epoch is not the current one is dropped."""
    current = 0
    for prior, new, _ in rows:
        fits = prior == current
        current = new if fits else current
        yield fits


def greedy_moves(replicas: list[tuple[int, int]], loads: dict[int, int], leaving: int, racks: dict[int, str] | None = None) -> dict[int, int | None]:
    """part -> the least loaded broker that does not hold it yet, loads updated on the way; None where there is none.

    Brokers in a named rack that the partition's other replicas do not cover go first.
    """
    racks, held = racks or {}, {}
    for part, broker in replicas:
        held.setdefault(part, set()).add(broker)
    loads, out = {b: n for b, n in loads.items() if b != leaving}, {}
    for part in sorted(p for p, own in held.items() if leaving in own):
        covered = {racks.get(b, "") for b in held[part] if b != leaving} | {""}
        free = [(racks.get(b, "") in covered, n, b) for b, n in loads.items() if b not in held[part]]
        out[part] = min(free)[2] if free else None
        if free:
            loads[out[part]] += 1
    return out


def replayed(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable[[Iterator], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``step`` makes of each key's rows in order; the keys stand in front of ``schema``.

    Rows are exchanged by key, sorted outside the heap, and pass through ``step`` one by one: memory holds one batch and
    the step's own state, however many rows a key has.  A key is one task, as its order is.
    """
    kinds = dict(rows.dtypes)
    return _in_order(rows, keys, order, columns, step, "".join(f"`{k}` {kinds[k]}, " for k in keys) + schema, None)


def folded(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable[[Iterator], Iterable], result: str, kind: str) -> DataFrame:
    """rows with ``result`` from folding each key's rows in order, one value a row; see replayed()."""
    return _in_order(rows, keys, order, columns, step, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{result}` {kind}", result)


def _in_order(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], step, schema: str, result: str | None) -> DataFrame:
    names, target = rows.columns, to_arrow_schema(StructType.fromDDL(schema))
    key_of, picked = itemgetter(*map(names.index, keys)), itemgetter(*map(names.index, columns))

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for key, group in groupby(stream, key_of):
            head, waiting = key if len(keys) > 1 else (key,), deque()

            def values(group=group, waiting=waiting):
                for row in group:
                    if result is not None:
                        waiting.append(row)
                    yield picked(row)

            for found in step(values()):
                out.append((*waiting.popleft(), found) if result is not None else (*head, *found))
                if len(out) == 8_192:
                    yield table(out)
                    out = []
        if out:
            yield table(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
