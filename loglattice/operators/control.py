"""Cluster metadata: the metadata log's current state, gates, role reports, recovery and draining of brokers.

Broker, topic and member frames are as large as the cluster, not as the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.stateful import greedy_moves


def meta_fold(records: DataFrame) -> DataFrame:
    """Current state of a metadata log: records(off, kind, name, item, value, leader_epoch, partition_epoch).

    A topic lives from its first ``topic`` record behind its last ``delete_topic``; later ``topic`` and ``config`` records
    replace its value, a ``config`` without a living topic does nothing.  Deletion takes the partition states before it.
    ``partition`` states win by (leader epoch, partition epoch), equal ones keep the earlier; ``acl`` and ``broker`` are
    last writes, ``remove_acl`` removes; a ``reassignment`` without a value clears; ``producer_id`` never falls.
    Returns (entity, name, item, value).
    """
    entity = (
        F.when(F.col("kind") == "delete_topic", F.array(F.lit("topic"), F.lit("partition")))
        .when(F.col("kind") == "config", F.array(F.lit("topic")))
        .when(F.col("kind") == "remove_acl", F.array(F.lit("acl")))
        .otherwise(F.array("kind"))
    )
    rows = records.withColumn("entity", F.explode(entity))
    whole = F.col("entity").isin("topic", "producer_id", "broker")
    rows = rows.withColumn("item", F.when(~whole, F.col("item"))).withColumn("name", F.when(F.col("entity") != "producer_id", F.col("name")))
    topic = Window.partitionBy("entity", "name")
    rows = rows.withColumn("gone", F.coalesce(F.max(F.when(F.col("kind") == "delete_topic", F.col("off"))).over(topic), F.lit(-1)))
    rows = rows.where("off > gone").withColumn("born", F.min(F.when(F.col("kind") == "topic", F.col("off"))).over(topic))
    rows = rows.where("kind <> 'config' or off > born")
    zero = F.lit(0).cast("long")
    first = F.when(F.col("entity") == "partition", F.col("leader_epoch")).when(F.col("entity") == "producer_id", F.col("value")).otherwise(zero)
    second = F.when(F.col("entity") == "partition", F.col("partition_epoch")).otherwise(zero)
    third = F.when(F.col("entity") == "partition", -F.col("off")).otherwise(F.col("off"))
    last = rows.groupBy("entity", "name", "item").agg(F.max_by(F.struct("kind", "value"), F.struct(first, second, third)).alias("r"))
    kept = (F.col("r.kind") != "remove_acl") & ((F.col("entity") != "reassignment") | F.col("r.value").isNotNull())
    return last.where(kept).select("entity", "name", "item", F.col("r.value").alias("value"))


def produce_gate(requests: DataFrame, gates: Sequence[tuple[str, Column]], passed: str = "NONE") -> DataFrame:
    """requests with ``error``: the code of the first gate, in order, whose predicate holds; null predicates do not hold."""
    error = F.lit(passed)
    for code, fails in reversed(gates):
        error = F.when(fails, code).otherwise(error)
    return requests.withColumn("error", error)


# fixed values: the error codes of a produce request
PRODUCE_ERRORS = {"INVALID_PARTITION": 2, "UNKNOWN_TOPIC": 1, "CORRUPT_BATCH": 3, "NOT_LEADER": 5, "NOT_ENOUGH_REPLICAS": 9, "MESSAGE_TOO_LARGE": 11, "STORAGE_FULL": 12, "UNAUTHORIZED": 13, "QUOTA_VIOLATED": 86}


def produce_errors(requests: DataFrame) -> DataFrame:
    """requests with ``error``, the code of the first gate that refuses, 0 if all let it pass.

    In order: access, quota, topic, partition number, size, disk, leadership, in-sync floor for acks = -1, damage, and
    control batches, which no client may produce.  requests(authorized, in_quota, known_topic, partitions, part, size,
    max_bytes, disk_low, leads, acks, isr, min_isr, corrupt, control).
    """
    c, code = F.col, PRODUCE_ERRORS
    gates = [
        ("UNAUTHORIZED", ~c("authorized")),
        ("QUOTA_VIOLATED", ~c("in_quota")),
        ("UNKNOWN_TOPIC", ~c("known_topic")),
        ("INVALID_PARTITION", (c("part") < 0) | (c("part") >= c("partitions"))),
        ("MESSAGE_TOO_LARGE", c("size") > c("max_bytes")),
        ("STORAGE_FULL", c("disk_low")),
        ("NOT_LEADER", ~c("leads")),
        ("NOT_ENOUGH_REPLICAS", (c("acks") == -1) & (c("isr") < c("min_isr"))),
        ("CORRUPT_BATCH", c("corrupt") | c("control")),
    ]
    error = F.coalesce(*(F.when(refuses, code[name]) for name, refuses in gates), F.lit(0))
    return requests.withColumn("error", error.cast("long"))


def offline_partitions(states: DataFrame, alive: DataFrame) -> DataFrame:
    """Partitions states(part, isr) with no living broker(broker) in their in-sync list."""
    led = states.select("part", F.explode("isr").alias("broker")).join(F.broadcast(alive.select("broker")), "broker", "left_semi")  # brokers of a cluster
    return states.join(led.select("part").distinct(), "part", "left_anti").select("part")


def commit_guard(commits: DataFrame, members: DataFrame) -> DataFrame:
    """commits(grp, member, epoch, ...) with ``error``; an epoch behind the member's is accepted, one ahead is fenced."""
    known = members.select("grp", "member", F.col("epoch").alias("own"))
    error = F.when(F.col("own").isNull(), "UNKNOWN_MEMBER_ID").when(F.col("epoch") > F.col("own"), "FENCED_MEMBER_EPOCH").otherwise("NONE")
    return commits.join(known, ["grp", "member"], "left").withColumn("error", error).drop("own")


def visible_topics(topics: DataFrame) -> DataFrame:
    """Topics that are not marked internal; an unmarked one is visible."""
    return topics.where(~F.coalesce("internal", F.lit(False)))


def format_gate(folders: DataFrame, supported: int) -> DataFrame:
    """folders(path, version) with ``opens``: a folder without a version is of the first; newer ones are refused."""
    return folders.withColumn("opens", F.coalesce("version", F.lit(1)) <= supported)


def disk_headroom_low(brokers: DataFrame, watermark: int) -> DataFrame:
    return brokers.withColumn("low", F.col("usable") < watermark)


def role_merge(reports: DataFrame) -> DataFrame:
    """reports(responder, node, role): the first responder's concrete role for each node, else UNKNOWN."""
    concrete = F.when(F.col("role") != "UNKNOWN", F.col("responder"))
    return reports.groupBy("node").agg(F.coalesce(F.min_by("role", concrete), F.lit("UNKNOWN")).alias("role"))


def recover_offline(partitions: DataFrame, live: DataFrame) -> DataFrame:
    """Leaderless partitions(part, isr, epoch): the first in-sync member among live(broker) leads, its epoch one higher."""
    members = partitions.select("part", "epoch", F.posexplode("isr").alias("pos", "broker"))
    found = members.join(live.select("broker").distinct(), "broker", "left_semi").groupBy("part", "epoch")
    return found.agg(F.min_by("broker", "pos").alias("leader")).select("part", "leader", (F.col("epoch") + 1).alias("epoch"))


def plan_decommission(replicas: DataFrame, brokers: DataFrame, leaving: int) -> DataFrame:
    """(part, replacement, refused) of every partition that holds ``leaving``; one without an eligible broker refuses all.

    replicas(part, broker), brokers(broker, rack) of live brokers.  Each move changes the loads that the next one sees,
    so the plan is one fold over the metadata.
    """
    both = replicas.select("part", "broker", F.lit(None).cast("string").alias("rack")).unionByName(brokers.select(F.lit(None).cast("long").alias("part"), "broker", "rack"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, known = rows[rows.part.notna()], rows[rows.part.isna()]
        pairs = [(int(p), int(b)) for p, b in zip(held.part, held.broker, strict=True)]
        racks = {int(b): r or "" for b, r in zip(known.broker, known["rack"], strict=True)}
        loads = {b: sum(x == b for _, x in pairs) for b in racks}
        moves = greedy_moves(pairs, loads, leaving, racks)
        return pd.DataFrame({"part": list(moves), "replacement": pd.array(list(moves.values()), dtype="Int64"), "refused": any(b is None for b in moves.values())})

    return both.groupBy().applyInPandas(run, "part long, replacement long, refused boolean")


def stage_cooperative(members: DataFrame) -> DataFrame:
    """members(member, current, target, epoch): what a member holds next, what waits for its acknowledgement, its epoch.

    Partitions to give up go first: the kept ones are advertised, and the target waits unless nothing is added.
    """
    kept = F.filter("current", lambda p: F.array_contains("target", p))
    loses = F.size(F.array_except("current", "target")) > 0
    staged = members.withColumn("held", F.when(loses, kept).otherwise(F.col("target")))
    pending = F.when(loses & ~same_set(F.col("held"), F.col("target")), F.col("target"))
    return staged.withColumns({"pending": pending, "epoch": F.col("epoch") + F.when(same_set(F.col("held"), F.col("current")), 0).otherwise(1)})


def same_set(left: Column, right: Column) -> Column:
    return F.array_sort(left).eqNullSafe(F.array_sort(right))


def verify_sink(log: DataFrame, sink: DataFrame) -> DataFrame:
    """log(part, off, wanted) against sink(part, off, sink): rows, missing, duplicated and differing ones by partition."""
    found = sink.groupBy("part", "off").agg(F.count("*").alias("times"), F.min("sink").alias("low"), F.max("sink").alias("high"))
    rows = log.join(found, ["part", "off"], "left")
    differs = F.col("times").isNotNull() & ~(F.col("low").eqNullSafe(F.col("wanted")) & F.col("high").eqNullSafe(F.col("wanted")))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("times") > 1).alias("duplicated"), F.count_if(differs).alias("mismatches"))
