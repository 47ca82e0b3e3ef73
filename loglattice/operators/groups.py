"""Consumer groups: assignment, committed offsets, lag, expiry and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.txn import latest_by


def committed_offsets(commits: DataFrame) -> DataFrame:
    """Last write per (grp, part); a null commit removes the entry."""
    return latest_by(commits.select("grp", "part", "log_pos", "committed"), ["grp", "part"], "log_pos").where("committed is not null").select("grp", "part", "committed")


def consumer_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """lag is -1 where the end is unknown, else the clamped distance to it."""
    joined = committed.join(ends, "part", "left")
    hwm = F.coalesce("leo", F.lit(-1).cast("long"))
    lag = F.when(F.col("leo").isNull(), F.lit(-1).cast("long")).otherwise(F.greatest(F.col("leo") - F.col("committed"), F.lit(0).cast("long")))
    return joined.select("grp", "part", "committed", hwm.alias("hwm"), lag.alias("lag"))


def assign_range(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """members(topic, member), partitions(topic, n): contiguous shares, the first ``extra`` members one more."""
    seats = members.withColumn("i", F.row_number().over(Window.partitionBy("topic").orderBy("member")) - 1)
    seats = seats.join(members.groupBy("topic").agg(F.count("*").alias("m")), "topic").join(partitions, "topic")
    base, extra = F.floor(F.col("n") / F.col("m")), F.col("n") % F.col("m")
    start = F.col("i") * base + F.least("i", extra)
    size = base + F.when(F.col("i") < extra, 1).otherwise(0)
    rows = seats.select("topic", "member", start.cast("long").alias("start"), size.cast("long").alias("size")).where("size > 0")
    return rows.select("topic", "member", F.explode(F.sequence("start", F.expr("start + size - 1"))).alias("part"))


def assign_uniform(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """Round robin of the sorted partitions over the sorted members, all subscribed alike."""
    seats = members.select("member").distinct().withColumn("i", F.row_number().over(Window.orderBy("member")) - 1)
    many = members.agg(F.countDistinct("member").alias("m"))
    tp = partitions.select("topic", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"))
    tp = tp.withColumn("k", F.row_number().over(Window.orderBy("topic", "part")) - 1).join(F.broadcast(many))
    return tp.withColumn("i", F.col("k") % F.col("m")).join(seats, "i").select("topic", "member", "part")


def assignment_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["topic", "member", "part"]
    gone, added = old.join(new, keys, "left_anti"), new.join(old, keys, "left_anti")
    return gone.withColumn("change", F.lit("revoked")).unionByName(added.withColumn("change", F.lit("added")))


def group_poll(log: DataFrame, assigned: DataFrame, positions: DataFrame, most: int) -> DataFrame:
    """One fetch of at most ``most`` rows from each assigned(member, part), from positions(part, off) or the beginning on."""
    start = positions.select("part", F.col("off").alias("start"))
    rows = log.join(assigned.join(start, "part", "left"), "part").where(F.col("off") >= F.coalesce("start", F.lit(0)))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("off"))).where(F.col("r") <= most).select("member", "part", "off")


def offset_expiry(commits: DataFrame, members: DataFrame, cutoff) -> DataFrame:
    """Groups without a member whose newest commit is not later than the cutoff: commits(grp, ts), members(grp, member)."""
    idle = commits.join(members.select("grp").distinct(), "grp", "left_anti")
    return idle.groupBy("grp").agg(F.max("ts").alias("newest")).where(F.col("newest") <= cutoff)


def group_summary(groups: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """groups(grp, generation), members(grp, member): state, members, generation and coordinator partition of each group."""
    counted = groups.join(members.groupBy("grp").agg(F.count("*").alias("members")), "grp", "left")
    size = F.coalesce("members", F.lit(0).cast("long"))
    state = F.when(size > 0, "Stable").otherwise("Empty").alias("state")
    return counted.select("grp", state, size.alias("members"), "generation", F.pmod(java_string_hash("grp"), F.lit(n)).alias("part"))


def describe_group(owners: DataFrame, committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Committed offset, end, lag and owner of each partition: owners(grp, part, member), committed(grp, part, committed).

    An end that is not known here is -1, and so is its lag; a partition without an owner has the empty one.
    """
    rows = consumer_lag(committed, ends).join(owners, ["grp", "part"], "left")
    return rows.select("grp", "part", "committed", "hwm", "lag", F.coalesce("member", F.lit("")).alias("owner"))


def java_string_hash(text: str):
    """The 32-bit polynomial hash with base 31 over UTF-16 units, for texts of the basic plane's ASCII part."""
    codes = F.transform(F.split(F.col(text), ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total)


def coordinator_route(groups: DataFrame, leaders: DataFrame, n: int) -> DataFrame:
    """Coordinator partition of each group and its leader; -1 without one."""
    at = groups.withColumn("part", F.pmod(java_string_hash("grp"), F.lit(n)))
    return at.join(leaders, "part", "left").select("grp", "part", F.coalesce("leader", F.lit(-1).cast("long")).alias("leader"))


def session_eviction(signs: DataFrame, now: DataFrame, timeout: int) -> DataFrame:
    """signs(grp, member, at), now(now): members evicted because the next sign, or now, came too late: (grp, member, at)."""
    following = F.lead("at").over(Window.partitionBy("grp", "member").orderBy("at"))
    rows = signs.withColumn("_next", following).join(F.broadcast(now))  # one row
    return rows.where(F.coalesce("_next", "now") - F.col("at") > timeout).select("grp", "member", "at")


def member_topic_match(members: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, member) of members(member, topics) for the topics(topic) that exist."""
    return members.select("member", F.explode("topics").alias("topic")).join(topics.select("topic").distinct(), "topic", "left_semi").select("topic", "member")
