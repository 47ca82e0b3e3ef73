"""Throughput, latency, alerts and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latency_percentiles(samples: DataFrame, keep: int = 1024) -> DataFrame:
    """Nearest-rank p50, p99 and p999 over the last ``keep`` samples of each (broker, op), and n, the samples ever seen."""
    key = ["broker", "op"]
    numbered = samples.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("seq").desc())))
    recent = F.sort_array(F.collect_list(F.when(F.col("_r") <= keep, F.col("latency_us"))))  # at most ``keep`` values
    kept = numbered.groupBy(*key).agg(F.count("*").alias("n"), recent.alias("_v"))
    at = lambda p: F.element_at("_v", F.ceil(F.lit(p) * F.size("_v")).cast("int"))
    return kept.select(*key, "n", at(0.5).alias("p50"), at(0.99).alias("p99"), at(0.999).alias("p999"))


def latency_cluster(percentiles: DataFrame) -> DataFrame:
    """The worst broker's percentiles of each operation."""
    return percentiles.groupBy("op").agg(*(F.max(c).alias(c) for c in ("p50", "p99", "p999")))


def throughput(samples: DataFrame) -> DataFrame:
    """Counts, bytes and the window in seconds (at least 0.001) by broker and operation."""
    micros = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    seconds = F.greatest(F.lit(0.001), micros / 1e6)
    return samples.groupBy("broker", "op").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.round(seconds, 3).alias("window_s"), F.round(F.count("*") / seconds, 6).alias("rate"))


def metric_delta(series: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """last - first over the trailing window of event time."""
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-seconds, 0)
    return series.withColumn("delta", F.col("value") - F.first("value").over(w))


def metric_ring(series: DataFrame, keys: list[str], keep: int) -> DataFrame:
    return series.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seq").desc()))).where(F.col("_r") <= keep).drop("_r")


def health_badge(clusters: DataFrame) -> DataFrame:
    """red without a controller or quorum, yellow with a broker down, green otherwise."""
    quorum = F.floor(F.col("n") / 2.0) + 1
    return clusters.withColumn("badge", F.when(~F.col("has_controller") | (F.col("alive") < quorum), "red").when(F.col("alive") < F.col("n"), "yellow").otherwise("green"))


def under_replicated(replicas: DataFrame) -> DataFrame:
    return replicas.groupBy("part").agg(F.count_if("in_isr").alias("isr"), F.count("*").alias("n")).where("isr < n").select("part", "isr", "n")


def partition_metrics(replicas: DataFrame, ends: DataFrame, marks: DataFrame) -> DataFrame:
    """Log end, high watermark, size of the in-sync list and each follower's lag of every partition."""
    rows = replicas.join(ends.withColumnRenamed("leo", "_end"), "part").join(marks, "part", "left")
    lag = F.when(~F.col("is_leader"), F.struct("broker", F.greatest(F.col("_end") - F.col("leo"), F.lit(0).cast("long")).alias("lag")))
    lags = F.array_join(F.transform(F.array_sort(F.collect_list(lag)), lambda x: F.concat_ws(":", x["broker"], x["lag"])), ",")
    return rows.groupBy("part", F.col("_end").alias("leo"), "hwm").agg(F.count_if("in_isr").alias("isr"), lags.alias("lags"))


def hwm_overlay(responses: DataFrame) -> DataFrame:
    """responses(part, seq, hwm) of all brokers: the last that knows the watermark counts, -1 where none does."""
    return responses.groupBy("part").agg(F.coalesce(F.max_by("hwm", F.when(F.col("hwm") >= 0, F.col("seq"))), F.lit(-1).cast("long")).alias("hwm"))


def alert_rules(replicas: DataFrame, ends: DataFrame, offline: DataFrame, disks: DataFrame, most_lag: int) -> DataFrame:
    """What fires now, as (alert, label, value); how long a rule has held is the window of the series it is run over."""
    low = under_replicated(replicas).select(F.lit("under_replicated").alias("alert"), F.col("part").cast("string").alias("label"), F.col("isr").alias("value"))
    lag = replicas.where("not is_leader").join(ends.withColumnRenamed("leo", "_end"), "part").withColumn("value", F.col("_end") - F.col("leo")).where(F.col("value") > most_lag)
    lag = lag.select(F.lit("replication_lag_high").alias("alert"), F.concat_ws("/", "part", "broker").alias("label"), "value")
    gone = offline.agg(F.count("*").alias("value")).where("value > 0").select(F.lit("offline_partitions").alias("alert"), F.lit("cluster").alias("label"), "value")
    full = disks.where("low").select(F.lit("disk_headroom_low").alias("alert"), F.col("broker").cast("string").alias("label"), F.col("usable").alias("value"))
    return low.unionByName(lag).unionByName(gone).unionByName(full)


def stalled(series: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Rows of series(t, value, leo) whose value has not moved over the window although the log end lies beyond it."""
    return metric_delta(series, keys, seconds).where((F.col("delta") == 0) & (F.col("leo") > F.col("value")))


def backoff_ms(attempt, first: int, most: int):
    """Milliseconds before a retry: doubling from ``first`` up to ``most``."""
    return F.least(F.lit(first) * F.pow(F.lit(2), attempt), F.lit(most)).cast("long")
