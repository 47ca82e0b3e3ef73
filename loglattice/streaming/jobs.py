"""Structured Streaming forms of the log operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loglattice.operators import stateful
from loglattice.sources.tables import committed, shared_folder, transact


def events_stream(spark: SparkSession, folder: str, schema, glob: str = "[e]vents.parquet") -> DataFrame:
    """The events, a file or a folder of files in no order: all files that are there make one micro-batch.

    The path is a pattern, since the source takes a plain one to be a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{glob}")


def from_position(stream: DataFrame, column: str, start: int) -> DataFrame:
    """Rows from a position on: seek.  The beginning is 0; a new position needs a new checkpoint."""
    return stream.where(F.col(column) >= start)


def tumbling_counts(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped with their window closed."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def dedup_stream(stream: DataFrame) -> DataFrame:
    """Exact sequence deduplication: stream(part, pid, seq, n) -> with verdict; state is the last accepted batch.

    A key's rows of one micro-batch come in several frames in no order and are sorted together in memory; dedup_sink()
    sorts them outside of it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        frame = pd.concat(list(frames)).sort_values(["seq", "n"], kind="stable").reset_index(drop=True)
        head = [] if last is None else [tuple(last)]
        rows = head + list(frame[["seq", "n"]].itertuples(index=False, name=None))
        verdicts = list(stateful.dedup_steps(rows))
        last = next((r for r, v in zip(reversed(rows), reversed(verdicts), strict=True) if v == "append"), None)
        frame["verdict"] = verdicts[len(head) :]
        if last is not None:
            state.update((int(last[0]), int(last[1])))
        yield frame[["part", "pid", "seq", "n", "verdict"]]

    out = "part long, pid long, seq long, n long, verdict string"
    return stream.groupBy("part", "pid").applyInPandasWithState(run, out, "seq long, n long", "append", GroupStateTimeout.NoTimeout)


def dedup_sink(stream: DataFrame, target: str, checkpoint: str):
    """dedup_stream() into a folder a micro-batch, named by it, in the memory of one batch of rows however many a key has.

    Beside its rows each micro-batch leaves the last accepted batch of every key, where the next one goes on; a replayed
    one reads what was there before it and overwrites itself.
    """
    columns, state, kind = ["part", "pid", "seq", "n"], f"{checkpoint}-last", "part long, pid long, seq long, n long"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = spark.read.schema(kind).parquet(f"{state}/batch={number - 1}") if number else spark.createDataFrame([], kind)
        rows = batch.select(columns).withColumn("fresh", F.lit(True)).unionByName(last.withColumn("fresh", F.lit(False)))
        judged = stateful.folded(rows, ["part", "pid"], ["fresh", "seq", "n"], ["seq", "n"], stateful.dedup_steps, "verdict", "string")
        judged.where("fresh").drop("fresh").write.mode("overwrite").parquet(f"{target}/batch={number}")
        found = spark.read.parquet(f"{target}/batch={number}").where("verdict = 'append'").select(columns)
        newest = found.unionByName(last).groupBy("part", "pid").agg(F.max(F.struct("seq", "n")).alias("last"))
        newest.select("part", "pid", "last.*").write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exactly_once_sink(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Write each micro-batch to its own folder, named by the batch: a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's whole result as a table in the shared folder, written by its tasks: nothing passes the driver.

    In complete mode every micro-batch replaces the result before it.
    """
    spark = stream.sparkSession
    path, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    job = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        job.format("parquet").option("path", path).start().awaitTermination()
    else:
        job.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def transactional_sink(stream: DataFrame, path: str, checkpoint: str, offsets: Callable[[DataFrame], DataFrame], transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Consume, transform, produce: each micro-batch is one transaction of its rows and the offsets it consumed.

    A batch that is replayed after a failure has the same number and replaces itself, so every record counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        transact(batch.sparkSession, path, number, {"rows": transform(batch), "offsets": offsets(batch)})
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_positions(spark: SparkSession, path: str) -> DataFrame:
    """The position behind the last committed transaction of each (grp, part)."""
    return committed(spark, path, "offsets").groupBy("grp", "part").agg(F.max_by("position", "txn").alias("position"))
