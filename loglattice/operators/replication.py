"""Replication and metadata: high watermarks, leader epochs, in-sync replicas, placement and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def high_watermark(replicas: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Smallest log end over the in-sync replicas; one never seen counts as 0; never below prior(part, floor)."""
    unseen = F.count_if(F.col("leo").isNull()) > 0
    marks = replicas.where("in_isr").groupBy("part").agg(F.when(unseen, F.lit(0).cast("long")).otherwise(F.min("leo")).alias("hwm"))
    return marks if prior is None else marks.join(prior, "part", "left").select("part", F.greatest("hwm", "floor").alias("hwm"))


def hwm_history(candidates: DataFrame, order: str, value: str) -> DataFrame:
    """The watermark never falls: a running maximum."""
    w = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return candidates.withColumn("hwm", F.max(value).over(w))


def epoch_for_offset(epochs: DataFrame, rows: DataFrame) -> DataFrame:
    """Backward as-of join on offsets: epoch starts and rows in one sorted pass, the last start carried forward."""
    starts = epochs.select("part", F.col("start_off").alias("off"), F.lit(0).alias("kind"), "epoch", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("part", "off")])
    both = starts.unionByName(rows.withColumns({"kind": F.lit(1), "epoch": F.lit(None).cast("long")}))
    w = Window.partitionBy("part").orderBy("off", "kind", F.col("epoch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("epoch", F.last("epoch", ignorenulls=True).over(w)).where("kind = 1").drop("kind")


def offsets_for_leader_epoch(epochs: DataFrame, ends: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(part, req): start of the epoch after the floor epoch, the log end if it is the last, -1 without one.

    A backward as-of join on epochs in one sorted pass per partition; requests of partitions without a log end go.
    """
    following = F.coalesce(F.lead("start_off").over(Window.partitionBy("part").orderBy("epoch")), F.lit(-1))
    spans = epochs.select("part", F.col("epoch").alias("req"), F.lit(0).alias("kind"), following.alias("next_start"))
    both = spans.unionByName(requests.select("part", "req", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("next_start")))
    w = Window.partitionBy("part").orderBy("req", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("floor", F.last("next_start", ignorenulls=True).over(w)).where("kind = 1").join(ends, "part")
    end = F.when(F.col("floor").isNull(), F.lit(-1).cast("long")).when(F.col("floor") == -1, F.col("leo")).otherwise(F.col("floor"))
    return found.select("part", "req", end.alias("end_offset"))


def epoch_lineage(log: DataFrame) -> DataFrame:
    """First offset of each epoch increase."""
    before = F.max("leader_epoch").over(Window.partitionBy("part").orderBy("off").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("_before", before).where("_before is null or leader_epoch > _before").select("part", F.col("leader_epoch").alias("epoch"), F.col("off").alias("start_off"))


def laggards(followers: DataFrame, now: int, timeout: int) -> DataFrame:
    """Followers whose last fetch is older than the timeout, or that never fetched: followers(part, broker, last_fetch, ...)."""
    return followers.where(F.col("last_fetch").isNull() | (F.col("last_fetch") < now - timeout))


def isr_shrink_expand(replicas: DataFrame, now: int, timeout: int) -> DataFrame:
    """New in-sync lists of the partitions whose list changes.

    replicas(part, broker, is_leader, in_isr, leo, last_fetch, first_seen): an in-sync follower goes when its last fetch is
    older than the timeout, one that never fetched only once the timeout has passed since it was first seen missing; a
    replica outside that fetched and has reached the high watermark comes in behind the others.  The leader stays.
    """
    stale = F.col("last_fetch") < now - timeout
    missing = F.col("last_fetch").isNull() & (now - F.coalesce("first_seen", F.lit(now)) >= timeout)
    goes = F.col("in_isr") & ~F.col("is_leader") & F.coalesce(stale | missing, F.lit(False))
    rows = replicas.join(high_watermark(replicas.withColumn("leo", F.when(F.col("is_leader") | F.col("last_fetch").isNotNull(), F.col("leo")))), "part")
    comes = ~F.col("in_isr") & ~F.col("is_leader") & F.col("last_fetch").isNotNull() & (F.col("leo") >= F.col("hwm"))
    marked = rows.withColumns({"goes": goes, "comes": F.coalesce(comes, F.lit(False))})
    stays = F.when((F.col("in_isr") & ~F.col("goes")) | F.col("comes"), F.struct("comes", "broker"))
    lists = marked.groupBy("part").agg(F.array_sort(F.collect_list(stays)).alias("isr"), F.bool_or(F.col("goes") | F.col("comes")).alias("changes"))
    return lists.where("changes").select("part", F.array_join(F.transform("isr", lambda b: b["broker"].cast("string")), ",").alias("isr"))


def pick_new_leader(partitions: DataFrame, dead: int) -> DataFrame:
    """First in-sync replica that is not dead; none: -1, the list kept; the epoch rises where the leader moves."""
    moved = F.col("leader") == dead
    first = F.coalesce(F.try_element_at(F.filter("isr", lambda b: b != dead), F.lit(1)), F.lit(-1).cast("long"))
    return partitions.withColumns({"leader": F.when(moved, first).otherwise(F.col("leader")), "epoch": F.col("epoch") + F.when(moved, 1).otherwise(0)})


def preferred_leader(partitions: DataFrame) -> DataFrame:
    better = (F.col("leader") != F.col("replicas")[0]) & F.array_contains("isr", F.col("replicas")[0])
    return partitions.where(better).select("part", F.col("replicas")[0].alias("leader"), (F.col("epoch") + 1).alias("epoch"))


def replica_load(partitions: DataFrame) -> DataFrame:
    return partitions.select(F.explode("replicas").alias("broker")).groupBy("broker").agg(F.count("*").alias("n"))


def plan_reassignment(plans: DataFrame) -> DataFrame:
    """expand to the union, contract once the target is in sync, clear when done."""
    done = F.size(F.array_except("replicas", "target")) == 0
    ready = F.size(F.array_except("target", "isr")) == 0
    step = F.when(done & ready, "clear").when(ready, "contract").otherwise("expand")
    after = F.when(ready, F.col("target")).otherwise(F.array_union("replicas", "target"))
    return plans.withColumns({"step": step, "after": after})


def raft_commit_index(matches: DataFrame, term_starts: DataFrame | None = None) -> DataFrame:
    """Largest index held by a majority of voters: the match at place quorum from the top.

    With term_starts(part, start_off), the first index of the current term, an index of an older term does not commit: -1.
    """
    w = Window.partitionBy("part").orderBy(F.col("match_index").desc(), "broker")
    ranked = matches.withColumns({"r": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy("part"))})
    held = ranked.where(F.col("r") == F.floor(F.col("m") / 2.0) + 1).select("part", F.col("match_index").alias("commit_index"))
    if term_starts is None:
        return held
    current = F.col("commit_index") >= F.col("start_off")
    return held.join(term_starts, "part", "left").select("part", F.when(current, F.col("commit_index")).otherwise(F.lit(-1).cast("long")).alias("commit_index"))


def partition_state_merge(states: DataFrame) -> DataFrame:
    """Newest by (leader_epoch, partition_epoch); of equals the first seen."""
    return states.groupBy("part").agg(F.max_by(F.struct("leader", "leader_epoch", "partition_epoch"), F.struct("leader_epoch", "partition_epoch", -F.col("seq"))).alias("s")).select("part", "s.*")


def place_replicas(brokers: DataFrame, rf: int) -> DataFrame:
    """``rf`` of the candidates brokers(broker, rack, load, seat), as (place, broker, rack).

    The first by seat is the anchor.  The others queue in their racks by load and broker, and racks take turns from the one
    behind the anchor's on, a missing or empty rack label last.  With fewer than two named racks the first ``rf`` by seat.
    Candidates are brokers, as many as the cluster has: windows over all of them are small.
    """
    everyone, named = Window.orderBy("seat"), F.nullif(F.col("rack"), F.lit(""))
    rows = brokers.withColumns({"rack": F.coalesce("rack", F.lit("")), "turn0": F.row_number().over(everyone), "racks": F.size(F.collect_set(named).over(Window.partitionBy()))})
    rows = rows.withColumn("anchor", F.max(F.when(F.col("turn0") == 1, F.col("rack"))).over(Window.partitionBy()))
    others = rows.where("turn0 > 1")
    order = others.select("rack").distinct().withColumn("i", F.row_number().over(Window.orderBy(F.col("rack") == "", "rack")) - 1)
    order = order.withColumn("m", F.count("*").over(Window.partitionBy()))
    start = F.coalesce(F.max(F.when(F.col("rack") == F.col("anchor"), F.col("i"))).over(Window.partitionBy()), F.lit(-1)) + 1
    queued = others.join(order, "rack").withColumns({"q": F.row_number().over(Window.partitionBy("rack").orderBy("load", "broker")), "start": start})
    queued = queued.withColumn("place", F.row_number().over(Window.orderBy("q", F.pmod(F.col("i") - F.col("start"), F.col("m")))) + 1)
    placed = rows.where("turn0 = 1").select(F.lit(1).alias("place"), "broker", "rack").unionByName(
        queued.select(F.when(F.col("racks") < 2, F.col("turn0")).otherwise(F.col("place")).alias("place"), "broker", "rack")
    )
    return placed.where(F.col("place") <= rf)
