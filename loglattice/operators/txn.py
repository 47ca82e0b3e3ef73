"""Transactional visibility: markers, the last stable offset, aborted ranges and committed-only reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _with_next_marker(log: DataFrame) -> DataFrame:
    """The next marker of the row's producer in its partition: one marker closes the producer's whole open range.

    Read from the end backwards, so that the marker is carried along: time linear in the rows.
    """
    behind = Window.partitionBy("part", "pid").orderBy(F.desc("off")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marker = F.when(F.col("is_control"), F.struct("off", "marker"))
    found = log.withColumn("_next", F.last(marker, ignorenulls=True).over(behind))
    return found.withColumns({"next_marker_off": F.col("_next.off"), "next_marker": F.col("_next.marker")}).drop("_next")


def aborted_txn_index(log: DataFrame) -> DataFrame:
    """(part, pid, first_off, last_off) of every aborted transaction, the marker's offset last."""
    rows = _with_next_marker(log.where("pid > 0")).where("not is_control and next_marker = 'ABORT'")
    return rows.groupBy("part", "pid", F.col("next_marker_off").alias("last_off")).agg(F.min("off").alias("first_off")).select("part", "pid", "first_off", "last_off")


def aborted_in_window(index: DataFrame, start: int, end: int) -> DataFrame:
    return index.where((F.col("first_off") < end) & (F.col("last_off") >= start))


def last_stable_offset(log: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """min(first offset of the earliest open transaction, bound); the bound is the log end unless given (part, bound)."""
    return _stable(_with_next_marker(log), bound)


def _stable(rows: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    opened = F.min(F.when(~F.col("is_control") & (F.col("pid") > 0) & F.col("next_marker_off").isNull(), F.col("off")))
    ends = rows.groupBy("part").agg(opened.alias("opened"), (F.max("off") + 1).alias("leo"))
    if bound is not None:
        ends = ends.join(bound, "part").withColumn("leo", F.least("leo", "bound"))
    return ends.select("part", F.least(F.coalesce("opened", "leo"), "leo").alias("lso"))


def filter_read_committed(log: DataFrame) -> DataFrame:
    """Data rows below the last stable offset whose transaction committed, and all plain rows below it."""
    rows = _with_next_marker(log)
    rows = rows.join(F.broadcast(_stable(rows)), "part")  # a row a partition
    seen = ~F.col("is_control") & (F.col("off") < F.col("lso")) & ((F.col("pid") == 0) | (F.col("next_marker") == "COMMIT"))
    return rows.where(seen).drop("lso", "next_marker", "next_marker_off")


def filter_control(log: DataFrame) -> DataFrame:
    return log.where("not is_control")


def latest_by(changelog: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last record of each key, as a struct maximum with map-side combine."""
    rest = [c for c in changelog.columns if c not in keys]
    best = changelog.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*")


def pending_markers(states: DataFrame, partitions: DataFrame) -> DataFrame:
    """A marker for each partition of every decided transaction whose markers are not confirmed.

    states(txn_id, pid, epoch, state), partitions(txn_id, topic, part); open transactions are not decided yet.
    """
    decided = states.where(F.col("state").isin("PREPARE_COMMIT", "PREPARE_ABORT"))
    return decided.join(partitions, "txn_id").select("txn_id", "topic", "part", "pid", "epoch", (F.col("state") == "PREPARE_COMMIT").alias("commit"))


def producer_state(batches: DataFrame) -> DataFrame:
    """The last batch of each (part, pid, epoch): its sequence and last offset."""
    return batches.groupBy("part", "pid", "epoch").agg(F.max(F.struct("sequence", "last_off")).alias("r")).select("part", "pid", "epoch", "r.sequence", "r.last_off")


def producer_epoch_floor(log: DataFrame) -> DataFrame:
    return log.groupBy("part", "pid").agg(F.max("producer_epoch").alias("epoch"))
