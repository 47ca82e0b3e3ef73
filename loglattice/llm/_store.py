"""Tables in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with its file system; where it is unset on one machine a temporary one is set.

    A cluster must name it: its executors do not see the driver's temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loglattice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", whole).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loglattice/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; ``.stored_at`` is its place."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n long keys that Spark's hash partitioning deals to n different partitions of n."""
    found: dict[int, int] = {}
    at, step = 0, 16 * n + 64
    while len(found) < n:
        rows = spark.range(at, at + step, 1, 1).selectExpr("id", f"pmod(hash(id), {n}) as part").collect()
        for row in rows:
            found.setdefault(row["part"], row["id"])
        at += step
    return [found[i] for i in range(n)]


def bucket_keys(spark: SparkSession, size: int, each: int = 16 << 20) -> tuple[list[int], int]:
    """(keys, shares): keys dealt to different partitions by ``repartition(len(keys), key)``, each cut into ``shares``, so
    that ``size`` bytes spread evenly leave at most ``each`` in a share."""
    n = max(shuffle_partitions(spark), min(16_384, math.ceil(size / each)))
    return even_keys(spark, n), max(1, math.ceil(size / each / n))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def join_classes(rows: DataFrame, classes: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows left-joined with classes(key, count, ...), ``key`` unique there and ``count`` the number of rows that hold it.

    Classes that hold more than a 1,024th of all rows, at most 1,024 of them, are broadcast; the others meet their rows in
    a shuffle, where rows without a key or with a broadcast one are dealt by a key of their own.
    """
    names = [c for c in classes.columns if c not in (key, count)]
    hot = F.col(count) > total / 1024
    front = classes.where(hot).select(key, F.struct(*names).alias("_hot"))
    spread = F.when(F.col(key).isNotNull() & F.col("_hot").isNull(), F.col(key))
    own = rows.join(F.broadcast(front), key, "left").withColumn("_meet", spread)
    alone = F.xxhash64(*rows.columns, F.spark_partition_id())
    own = own.withColumn("_deal", F.when(F.col("_meet").isNull(), alone).otherwise(F.xxhash64("_meet")))
    back = classes.where(~hot).select(F.col(key).alias("_meet"), F.xxhash64(key).alias("_deal"), F.struct(*names).alias("_cold"))
    met = own.join(back, ["_deal", "_meet"], "left")
    return met.select(*rows.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in names))


SIFT = 1 << 23  # bits of the filter below, 1 MiB whatever it holds


def sifted(rows: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have their ``key`` in found, rows that cannot), by a broadcast filter of fixed size.

    Rows that cannot need no shuffle to meet found; once the filter is full all may, and lose nothing but that.
    """
    slot, held = "_slot", "_held"
    while {slot, held} & set(rows.columns):  # rows may have columns of any names
        slot, held = f"{slot}_", f"{held}_"
    bit = F.pmod(F.xxhash64(key), F.lit(SIFT))
    place = f"cast(pmod(xxhash64(`{key}`), {SIFT}) % 64 as int)"
    marks = found.select(F.shiftright(bit, 6).alias(slot), F.expr(f"shiftleft(1L, {place})").alias("mark")).groupBy(slot).agg(F.bit_or("mark").alias(held))
    marked = rows.withColumn(slot, F.shiftright(bit, 6)).join(F.broadcast(marks), slot, "left")  # at most SIFT / 64 rows
    may = F.expr(f"coalesce(getbit(`{held}`, {place}), 0) = 1")
    return marked.where(may).select(*rows.columns), marked.where(~may).select(*rows.columns)


def put(uri: str, data: bytes) -> None:
    """Write a file of the shared folder from a task: whole files only, and the same bytes from every attempt."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as file:
        return file.read()
