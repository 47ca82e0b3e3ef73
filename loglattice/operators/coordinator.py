"""Group and transaction coordinators replayed from their event logs: ordered folds, one key a group or producer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.stateful import replayed
from loglattice.operators.txn import latest_by


@dataclass
class _Member:
    instance: str
    seen: int
    epoch: int = 0
    held: tuple[int, ...] = ()
    pending: tuple[int, ...] | None = None

    def move(self, target: tuple[int, ...]) -> None:
        """Towards the target: give up first, take over once the smaller share is acknowledged."""
        kept = tuple(p for p in self.held if p in target)
        now = target if len(kept) == len(self.held) else kept
        self.pending = None if set(now) == set(target) else target
        if set(now) != set(self.held):
            self.epoch += 1
        self.held = now


class Group:
    """One consumer group over ``parts`` partitions: joins, heartbeats, leaves and evictions by the clock of its events.

    A join with a known instance takes that member's place back without a new generation.  Shares are contiguous over the
    sorted member ids.
    """

    def __init__(self, parts: int, timeout_ms: int):
        self.parts, self.timeout, self.members, self.generation = parts, timeout_ms, {}, 0

    def _changed(self) -> None:
        self.generation += 1
        start = 0
        for i, name in enumerate(sorted(self.members)):
            size = self.parts // len(self.members) + (i < self.parts % len(self.members))
            self.members[name].move(tuple(range(start, start + size)))
            start += size

    def step(self, at: int, event: str, name: str, instance: str, epoch: int, owned: tuple[int, ...]) -> tuple:
        """-> (outcome, member id, member epoch, generation, held)"""
        late = [n for n, m in self.members.items() if at - m.seen > self.timeout]
        if late:
            for n in late:
                del self.members[n]
            self._changed()
        outcome = "ok"
        if event == "join":
            before = next((n for n, m in self.members.items() if instance and m.instance == instance), None)
            if before is None:
                self.members[name] = _Member(instance, at)
                self._changed()
            else:
                name, outcome = before, "rejoined"
                self.members[name].seen = at
        elif name not in self.members:
            outcome = "unknown_member"
        elif event == "leave":
            del self.members[name]
            self._changed()
            outcome = "left"
        elif epoch > self.members[name].epoch:
            outcome = "fenced"
        else:
            own = self.members[name]
            own.seen = at
            if own.pending is not None and set(owned) == set(own.held):
                own.held, own.pending, own.epoch = own.pending, None, own.epoch + 1
            outcome = "assignment" if epoch < own.epoch else "ok"
        own = self.members.get(name)
        return outcome, name, own.epoch if own else 0, self.generation, list(own.held) if own else []


def group_steps(rows: Iterable[tuple], parts: int, timeout_ms: int) -> Iterator[tuple]:
    group = Group(parts, timeout_ms)
    return ((row[0], *group.step(*row[1:])) for row in rows)


def staging_steps(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Offsets staged in one producer's transactions: (log_pos, event, grp, part, committed, epoch), event stage, commit
    or abort -> (grp, part, committed, log_pos), folded at their marker's position.

    A stage older than the group's newest stage or decision is fenced, a newer one replaces it; a marker older than the
    stage leaves it.
    """
    staged: dict[str, tuple[int, dict]] = {}
    decided: dict[str, int] = {}
    for pos, event, grp, part, committed, epoch in rows:
        if event == "stage":
            if epoch < max(decided.get(grp, epoch), staged.get(grp, (epoch,))[0]):
                continue
            if grp not in staged or epoch > staged[grp][0]:
                staged[grp] = (epoch, {})
            staged[grp][1][part] = committed
            continue
        for name in [n for n, (own, _) in staged.items() if own <= epoch]:
            offsets = staged.pop(name)[1]
            decided[name] = max(decided.get(name, epoch), epoch)
            if event == "commit":
                yield from ((name, p, c, pos) for p, c in offsets.items())


def marker_steps(rows: Iterable[tuple], start: int = 0) -> Iterator[tuple]:
    """One partition's appends: (event, pid, epoch, coordinator_epoch, position), event data, commit or abort ->
    (position, outcome, off).

    A marker of an older coordinator is refused; a repeated one is not written twice while it is the log's last entry.
    """
    last: dict[int, tuple] = {}
    end = start
    for event, pid, epoch, coordinator, position in rows:
        if event != "data":
            known = last.get(pid)
            if known and coordinator < known[2]:
                yield (position, "refused", -1)
                continue
            if known and known[:3] == (event, epoch, coordinator) and known[3] == end - 1:
                yield (position, "repeated", known[3])
                continue
            last[pid] = (event, epoch, coordinator, end)
        yield (position, "appended", end)
        end += 1


def grant_steps(rows: Iterable[tuple[int, int]], rate: float, capacity: float) -> Iterator[int]:
    """(ms, wanted bytes) -> granted bytes, whole tokens of a bucket that starts empty; a rate of 0 grants all."""
    tokens, before = 0.0, None
    for ms, wanted in rows:
        if before is not None and ms > before:
            tokens = min(capacity, tokens + rate * (ms - before) / 1000)
        before = ms if before is None else max(before, ms)
        granted = wanted if rate <= 0 else max(0, min(wanted, int(tokens)))
        tokens -= granted if rate > 0 else 0
        yield granted


def raw_append_steps(rows: Iterable[tuple[int, int]], end: int = 0) -> Iterator[str]:
    """(base, last) of replicated batches in arrival order: one below the log end is rejected, a gap ahead is taken."""
    for base, last in rows:
        yield "append" if base >= end else "rejected"
        end = last + 1 if base >= end else end


def deal_steps(pairs: list[tuple[str, int]], subscribed: dict[str, set[str]]) -> list[tuple[str, int, str]]:
    """Deals (topic, part) in order round the sorted members; the turn passes on from whoever took the last one.

    A pair that nobody subscribes to is not dealt.
    """
    members, turn, out = sorted(subscribed), 0, []
    for topic, part in pairs:
        takers = [k for k, member in enumerate(members) if topic in subscribed[member]]
        if takers:
            taker = next((k for k in takers if k >= turn), takers[0])
            out.append((topic, part, members[taker]))
            turn = (taker + 1) % len(members)
    return out


def assign_uniform_mixed(subscriptions: DataFrame, partitions: DataFrame) -> DataFrame:
    """subscriptions(topic, member), partitions(topic, n) -> (topic, part, member), members subscribed to different topics.

    Who takes a partition depends on all before it: one fold over the group's metadata.
    """
    both = subscriptions.select("topic", "member", F.lit(None).cast("long").alias("n")).unionByName(partitions.select("topic", F.lit(None).cast("string").alias("member"), "n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        subscribed: dict[str, set[str]] = {}
        for topic, member in rows[rows.member.notna()][["topic", "member"]].itertuples(index=False):
            subscribed.setdefault(member, set()).add(topic)
        sizes = rows[rows.member.isna()].sort_values("topic")
        pairs = [(t, p) for t, n in zip(sizes.topic, sizes.n, strict=True) for p in range(int(n))]
        return pd.DataFrame(deal_steps(pairs, subscribed), columns=["topic", "part", "member"])

    return both.groupBy().applyInPandas(run, "topic string, part long, member string")


def group_lifecycle(events: DataFrame, parts: int, timeout_ms: int) -> DataFrame:
    """events(grp, seq, at_ms, event, member, instance, epoch, owned) -> the coordinator's answer to each."""
    schema = "seq long, outcome string, member string, member_epoch long, generation long, held array<bigint>"
    return replayed(events, ["grp"], ["seq"], ["seq", "at_ms", "event", "member", "instance", "epoch", "owned"], lambda rows: group_steps(rows, parts, timeout_ms), schema)


def committed_offsets_txn(events: DataFrame) -> DataFrame:
    """events(coordinator, pid, log_pos, event, grp, part, committed, epoch) -> (grp, part, committed) behind all markers.

    Folded per producer, so producers of one coordinator run apart; the last marker wins over producers.
    """
    folded = replayed(events, ["coordinator", "pid"], ["log_pos"], ["log_pos", "event", "grp", "part", "committed", "epoch"], staging_steps, "grp string, part long, committed long, log_pos long")
    return latest_by(folded.select("grp", "part", "committed", "log_pos"), ["grp", "part"], "log_pos").select("grp", "part", "committed")


def marker_log(events: DataFrame) -> DataFrame:
    """events(part, seq, event, pid, epoch, coordinator_epoch) -> (part, seq, outcome, off)."""
    return replayed(events, ["part"], ["seq"], ["event", "pid", "epoch", "coordinator_epoch", "seq"], marker_steps, "seq long, outcome string, off long")


def txn_timeout(transactions: DataFrame, now: int, timeout_ms: int) -> DataFrame:
    """Transactions(txn_id, state, epoch, at_ms) that stayed open too long, as they are aborted: epoch one higher."""
    idle = (F.col("state") == "ONGOING") & (F.lit(now) - F.col("at_ms") > timeout_ms)
    return transactions.where(idle).withColumns({"state": F.lit("PREPARE_ABORT"), "epoch": F.col("epoch") + 1})


def producer_lru(batches: DataFrame, most: int) -> DataFrame:
    """The ``most`` producers of each partition that appended last: batches(part, pid, off)."""
    last = batches.groupBy("part", "pid").agg(F.max("off").alias("off"))
    return last.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("off"), "pid"))).where(F.col("r") <= most).drop("r")
