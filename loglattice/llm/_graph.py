"""Connected components of an edge table, without gathering edges or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm._store import drop, join_classes, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node of ``edges(a, b)``.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
    minima are partial aggregates, so a hub of any degree is pre-aggregated, and a hub's edges meet its minimum by a
    broadcast of the at most 1,024 largest hubs.  Each step is a stored table.  Self loops keep single nodes; no edges give no rows.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null").distinct(),
        "edges",
    )
    last = None
    if not now.take(1):
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = now.where("a <> b").select("a", "b").unionByName(now.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("degree"))
        large = join_classes(both.where("b > a"), low, "a", "degree", 2 * now.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = join_classes(large, least, "a", "degree", large.count()).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        small = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "small")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        drop(large)
        if last is not None:
            drop(now)
        if state == last:
            break
        now, last = small, state
    labels = small.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
