"""Operators on one or more partitions of a topic log: offsets, scans, compaction, retention, segments.

A log frame has at least (part, off); ``part`` leads every window and grouping, so one exchange on it serves a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_part(*order, desc: bool = False):
    return Window.partitionBy("part").orderBy(*(F.col(o).desc() if desc else F.col(o) for o in order))


def assign_offsets(rows: DataFrame, order: str) -> DataFrame:
    """Dense offsets from 0 in each partition."""
    return rows.withColumn("off", (F.row_number().over(by_part(order)) - 1).cast("long"))


def log_end_offset(log: DataFrame) -> DataFrame:
    return log.groupBy("part").agg((F.max("off") + 1).alias("leo"))


def list_offsets(log: DataFrame) -> DataFrame:
    """earliest is the literal 0, also after retention; latest is the log end."""
    return log.groupBy("part").agg(F.lit(0).cast("long").alias("earliest"), (F.max("off") + 1).alias("latest"))


def scan_offset_range(log: DataFrame, part: int, start: int, stop: int) -> DataFrame:
    """Half-open range of one partition; both predicates reach the scan when off is stored."""
    return log.where((F.col("part") == part) & (F.col("off") >= start) & (F.col("off") < stop))


def scan_batches(batches: DataFrame, offset: int) -> DataFrame:
    return batches.where(F.col("last_off") >= offset)


def segment_lookup(segments: DataFrame, offset: int) -> DataFrame:
    """The segment with the greatest base at or below the offset, else the first."""
    floor = F.max(F.when(F.col("segment_base") <= offset, F.col("segment_base")))
    return segments.groupBy("part").agg(F.coalesce(floor, F.min("segment_base")).alias("segment_base"))


def offset_for_timestamp(log: DataFrame, ts: Column) -> DataFrame:
    return log.where(F.col("ts") <= ts).groupBy("part").agg(F.max("off").alias("off"))


def index_floor(entries: DataFrame, offset: int) -> DataFrame:
    return entries.where(F.col("base_off") <= offset).groupBy("part").agg(F.max("base_off").alias("base_off"))


def compact_latest_by_key(log: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Last value of each key; a null value deletes its key; null keys pass; offsets are kept.

    max(off) is a hash aggregate with map-side combine; joining it back costs less than a sort aggregate of whole rows.
    """
    last = log.where(F.col(key).isNotNull()).groupBy("part", F.col(key).alias("_k")).agg(F.max("off").alias("_last"))
    own = log.join(last, (log["part"] == last["part"]) & (log[key] == last["_k"]) & (log["off"] == last["_last"]), "left_semi").where(F.col(value).isNotNull())
    return log.where(F.col(key).isNull()).unionByName(own)


def segment_stats(log: DataFrame, size: int) -> DataFrame:
    base = (F.floor(F.col("off") / float(size)) * size).cast("long").alias("segment_base")
    return log.groupBy("part", base).agg((F.max("off") + 1).alias("next_off"), F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("n"))


def retention_size(segments: DataFrame, budget: int) -> DataFrame:
    """A head segment goes while the segments behind it hold the budget; the active one stays; a negative budget keeps all."""
    if budget < 0:
        return segments
    newest = by_part("segment_base", desc=True)
    later = F.sum("size_bytes").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size_bytes")
    kept = segments.withColumns({"_later": later, "_active": F.row_number().over(newest) == 1})
    return kept.where((F.col("_later") < budget) | F.col("_active")).drop("_later", "_active")


def retention_time(segments: DataFrame, cutoff: Column) -> DataFrame:
    """Head segments older than the cutoff go up to the first that is not; the active one stays."""
    active = F.lead("segment_base").over(by_part("segment_base")).isNull()
    keep = F.when((F.col("max_ts") >= cutoff) | active, 1).otherwise(0)
    kept = F.max("_keep").over(by_part("segment_base").rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("_keep", keep).withColumn("_kept", kept).where("_kept = 1").drop("_keep", "_kept")


def fetch_byte_budget(batches: DataFrame, offset: int, most: int) -> DataFrame:
    """Whole batches from the offset's batch on while their sizes fit; the first always."""
    running = F.sum("size_bytes").over(by_part("base_off").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(by_part("base_off")) == 1
    rest = batches.where(F.col("last_off") >= offset)
    return rest.withColumns({"_sum": running, "_first": first}).where((F.col("_sum") <= most) | F.col("_first")).drop("_sum", "_first")


def poll_max_records(log: DataFrame, most: int) -> DataFrame:
    """Rows in (partition, offset) order up to a total, and each partition's new position.

    Offsets are dense, so the rank of a row is its offset plus the sizes of the partitions before: no global sort.
    """
    sizes = log.groupBy("part").agg(F.min("off").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before)
    rank = F.row_number().over(by_part("off")) + F.col("_before")
    return log.join(sizes, "part").where(F.col("_before") < most).withColumn("_r", rank).where(F.col("_r") <= most).groupBy("part").agg(F.count("*").alias("n"), (F.max("off") + 1).alias("position"))


def verify_log(log: DataFrame, batch: int, segment: int) -> DataFrame:
    """Segments, batches, records, next offset, and whether offsets are dense, by partition."""
    return log.groupBy("part").agg(
        F.countDistinct(F.floor(F.col("off") / float(segment))).alias("segments"),
        F.countDistinct(F.floor(F.col("off") / float(batch))).alias("batches"),
        F.count("*").alias("records"),
        (F.max("off") + 1).alias("next_off"),
        (F.count("*") == F.max("off") - F.min("off") + 1).alias("dense"),
    )


def recover_torn_tail(frames: DataFrame, bad: Column) -> DataFrame:
    """Rows before the first invalid one of each partition."""
    first = F.min(F.when(bad, F.col("off"))).over(Window.partitionBy("part"))
    return frames.withColumn("_bad", first).where(F.col("_bad").isNull() | (F.col("off") < F.col("_bad"))).drop("_bad")


def diverged_tail(batches: DataFrame, ends: DataFrame) -> DataFrame:
    """Batches that remain after truncation to the leader's end offset, rounded down to whole batches."""
    return batches.join(ends, "part").where(F.col("base_off") < F.col("end_offset")).where(F.col("last_off") < F.col("end_offset")).drop("end_offset")


def filter_partial_tail(batches: DataFrame, most: int) -> DataFrame:
    """Batches that end within the first ``most`` bytes of their partition; what a fetch cut in its middle is left out."""
    end = F.sum("size_bytes").over(by_part("base_off").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return batches.withColumn("_end", end).where(F.col("_end") <= most).drop("_end")
