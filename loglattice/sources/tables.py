"""Logs and metadata as Parquet tables: appends that continue offsets, versioned snapshots, benchmark rows."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; on one machine without it, a temporary one.  A cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loglattice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loglattice/{name}-{uuid.uuid4().hex}"


def appended(ends: DataFrame, rows: DataFrame, order: str, clock: Column | None = None, epoch: int = 0) -> DataFrame:
    """rows(part, ...) with ``off`` from the log end of their partition on, in ``order``; stamped with clock and epoch.

    ends(part, leo) holds a row for each partition, so the join is planned by size; a new partition starts at 0.
    """
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    out = rows.withColumn("off", place.cast("long")).join(ends.select("part", "leo"), "part", "left")
    out = out.withColumn("off", F.col("off") + F.coalesce("leo", F.lit(0).cast("long"))).drop("leo")
    return out.withColumns({"append_ts": F.current_timestamp() if clock is None else clock, "leader_epoch": F.lit(epoch)})


def append(spark: SparkSession, path: str, rows: DataFrame, order: str, epoch: int = 0) -> None:
    """Append rows to the log table at ``path``, one folder a partition.  One writer at a time, as one leader appends."""
    from pyspark.errors import AnalysisException

    try:
        ends = spark.read.parquet(path).groupBy("part").agg((F.max("off") + 1).alias("leo"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        ends = spark.createDataFrame([], "part long, leo long")
    appended(ends, rows, order, epoch=epoch).write.mode("append").partitionBy("part").parquet(path)


def snapshot(path: str, version: int, frames: dict[str, DataFrame]) -> None:
    """Write every frame below a folder of that version; the manifest comes last, so a cut-off snapshot is not restored."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(version, name) for name in frames], "version long, name string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def restore(spark: SparkSession, path: str, supported: int | None = None) -> dict[str, DataFrame]:
    """The frames of the newest whole snapshot, none above ``supported``."""
    manifest = spark.read.parquet(f"{path}/manifest")
    if supported is not None:
        manifest = manifest.where(F.col("version") <= supported)
    newest = manifest.groupBy("version").agg(F.collect_set("name").alias("names")).orderBy(F.desc("version")).first()
    return {name: spark.read.parquet(f"{path}/version={newest['version']}/{name}") for name in newest["names"]} if newest else {}


def bench_rows(summary: DataFrame, least: int, **environment: str) -> DataFrame:
    """Percentile rows stamped with the environment; p99 is blank where fewer than ``least`` samples stand behind it."""
    return summary.withColumn("p99", F.when(F.col("n") >= least, F.col("p99"))).withColumns({k: F.lit(v) for k, v in environment.items()})


def dead_letters(rows: DataFrame, failure: Column, tries: int) -> tuple[DataFrame, DataFrame]:
    """(handled, dead): rows whose failure is null, and the rest with the cause and the number of tries as headers."""
    marked = rows.withColumn("cause", failure)
    dead = marked.where("cause is not null").withColumn("headers", F.create_map(F.lit("cause"), F.col("cause"), F.lit("tries"), F.lit(str(tries))))
    return marked.where("cause is null").drop("cause"), dead.drop("cause")


def through_csv(rows: DataFrame) -> DataFrame:
    """rows written as CSV with a header to the shared folder, and read back."""
    path = shared_folder(rows.sparkSession, "csv")
    rows.write.option("header", True).csv(path)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).csv(path)


def transact(spark: SparkSession, path: str, number: int, frames: dict[str, DataFrame], commit: bool = True) -> None:
    """Write transaction ``number``: every frame, then, only to commit, its marker; see transact_many().

    Readers go by markers, so an aborted or cut-off transaction is never seen, all frames of one appear at once, and a
    repeated number replaces itself: records and the offsets they came from commit together.
    """
    txn = spark.range(number, number + 1).toDF("txn")
    transact_many(path, {name: frame.withColumn("txn", F.lit(number).cast("long")) for name, frame in frames.items()}, txn if commit else txn.limit(0))


def transact_many(path: str, frames: dict[str, DataFrame], commits: DataFrame) -> None:
    """Write many transactions at once: frames hold each row's ``txn``, commits(txn) the numbers to commit.

    A write is one job a frame and one for the markers, however many transactions it holds.  It has folders of its own,
    which its markers name, so what an earlier write committed is seen until a marker of a later one replaces it.
    """
    write = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}/write={write}")
    commits.select("txn").distinct().write.parquet(f"{path}/committed/write={write}")


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of ``name`` in all committed transactions, each as last committed, with their transaction's number."""
    markers = spark.read.parquet(f"{path}/committed").groupBy("txn").agg(F.max("write").alias("write"))
    return spark.read.parquet(f"{path}/{name}").join(markers, ["txn", "write"]).drop("write")


def retried(rows: DataFrame, failure: Column, tries: int) -> tuple[DataFrame, DataFrame]:
    """dead_letters() of a handler tried ``tries`` times; ``failure(try)`` may name the column ``try``, from 1 on.

    A row is dead when every try fails, with the last try's cause; the handled rows carry the try that succeeded.
    """
    causes = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: F.struct(i.alias("try"), failure(i).alias("cause")))
    marked = rows.withColumn("_causes", causes)
    first = F.element_at(F.filter("_causes", lambda x: x["cause"].isNull()), 1)
    passed = marked.where(F.exists("_causes", lambda x: x["cause"].isNull())).withColumn("try", first["try"]).drop("_causes")
    failed = marked.where(F.forall("_causes", lambda x: x["cause"].isNotNull())).withColumn("cause", F.element_at("_causes", -1)["cause"]).drop("_causes")
    return passed, failed.withColumn("headers", F.create_map(F.lit("cause"), F.col("cause"), F.lit("tries"), F.lit(str(tries)))).drop("cause")


def console_lines(log: DataFrame) -> DataFrame:
    """Records as a console consumer prints them: partition, offset, key and value, null shown as such."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return log.select(F.concat_ws(" ", F.concat_ws("-", "part", "off"), F.concat(shown("k"), F.lit("="), shown("v"))).alias("line"))


def line_source(lines: DataFrame, partitions: int) -> DataFrame:
    """Lines(n, line) as records dealt round robin by line number, empty ones left out: (part, off, v)."""
    kept = lines.where("line <> ''").withColumn("part", F.pmod("n", F.lit(partitions)))
    return kept.select("part", (F.row_number().over(Window.partitionBy("part").orderBy("n")) - 1).cast("long").alias("off"), F.col("line").alias("v"))
