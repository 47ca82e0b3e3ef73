"""Registered queries of sinks, sources and streams: what was written is read back and held against SQL over the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.operators import control, stateful, txn
from loglattice.plans.registry import query
from loglattice.sources import recordbatch, tables
from loglattice.streaming import jobs

# sinks

_SEALED = """with recursive o as materialized (select part, off, v, size_bytes from v_log),
    s as (select o.*, 0::bigint as batch, o.size_bytes as total from o where off = 0
          union all select o.*, s.batch + case when s.total >= 200 then 1 else 0 end, case when s.total >= 200 then 0 else s.total end + o.size_bytes from s join o on o.part = s.part and o.off = s.off + 1)
    select part, off, v, min(off) over (partition by part, batch) as base_off from s"""


@query("sink_batching", _SEALED)
def _batching(f):
    """Rows sealed into batches by size, encoded, written, read again and decoded; each row with its batch's base offset."""
    rows = f.v_log.select("part", "off", "size_bytes", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lit(None).cast("binary").alias("key"), F.encode("v", "UTF-8").alias("value"))
    sealed = stateful.folded(rows, ["part"], ["off"], ["ts_ms", "size_bytes"], lambda r: stateful.seal_steps(r, 200, 1 << 60), "batch", "long")
    path = tables.shared_folder(f.spark, "batches")
    recordbatch.encoded_batches(sealed, zstd=True).write.parquet(path)
    back = recordbatch.decoded(f.spark.read.parquet(path))
    return back.select("part", "off", F.decode("value", "UTF-8").alias("v"), "base_off")


_WRITTEN = "select event_id, user_id % 5 as pid, event_id // 400 as txn from events"


@query("sink_transactional", f"select txn, event_id from ({_WRITTEN}) w where txn % 3 <> 1")
def _transactional(f):
    """Transactions of event ranges, one in three aborted: readers see the rows of the others."""
    path = tables.shared_folder(f.spark, "txn")
    rows = f.events.select("event_id", F.expr("event_id div 400").alias("txn"))
    tables.transact_many(path, {"rows": rows}, rows.where("txn % 3 <> 1"))
    return tables.committed(f.spark, path, "rows").select("txn", "event_id")


@query(
    "sink_control",
    """select part, off, event_id from v_tlog t where not is_control and (pid = 0 or exists (select 1 from v_tlog m where m.part = t.part and m.pid = t.pid and m.is_control and m.off > t.off
      and m.marker = 'COMMIT' and not exists (select 1 from v_tlog a where a.part = t.part and a.pid = t.pid and a.is_control and a.off > t.off and a.off < m.off)))
      and off < (select min(x) from (select max(off) + 1 as x from v_tlog e where e.part = t.part union all
        select min(d.off) from v_tlog d where d.part = t.part and d.pid > 0 and not d.is_control and d.off > coalesce((select max(c.off) from v_tlog c where c.part = d.part and c.pid = d.pid and c.is_control), -1)) z)""",
)
def _control(f):
    """Data and control batches written in the binary format and read again: markers and aborted rows are not given out."""
    rows = f.v_tlog.select("part", "off", "pid", "is_control", "marker", F.lit(0).cast("long").alias("ts_ms"), F.encode("marker", "UTF-8").alias("key"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value"))
    path = tables.shared_folder(f.spark, "control")
    recordbatch.encoded_batches(rows.withColumn("batch", F.col("off"))).write.parquet(path)
    back = recordbatch.decoded(f.spark.read.parquet(path))
    log = back.select("part", "off", F.col("producer_id").alias("pid"), "is_control", F.decode("key", "UTF-8").alias("marker"), F.decode("value", "UTF-8").cast("long").alias("event_id"))
    return txn.filter_read_committed(log).select("part", "off", "event_id")


@query("sink_dead_letter", "select part, off, case when v is null then 'no value' end as cause, case when v is null then null when event_id % 5 = 0 then 3 else 1 end as try from v_log")
def _dead_letter(f):
    """A handler that fails on null values, and twice on every fifth event, tried three times."""
    failure = lambda i: F.when(F.col("v").isNull(), "no value").when((F.col("event_id") % 5 == 0) & (i < 3), "busy")
    handled, dead = tables.retried(f.v_log, failure, 3)
    none = F.lit(None)
    return handled.select("part", "off", none.cast("string").alias("cause"), "try").unionByName(dead.select("part", "off", F.col("headers")["cause"].alias("cause"), none.cast("int").alias("try")))


query("scan_console", "select part || '-' || off || ' ' || coalesce(k::varchar, 'null') || '=' || coalesce(v, 'null') as line from v_log")(lambda f: tables.console_lines(f.v_log))


@query("source_stdin", "select event_id % 3 as part, row_number() over (partition by event_id % 3 order by event_id) - 1 as off, event_type as v from events where event_id % 10 <> 0")
def _lines(f):
    return tables.line_source(f.events.select(F.col("event_id").alias("n"), F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("event_type")).alias("line")), 3)


@query("sink_produce_simple", "select part, off, event_id from v_log")
def _produce_simple(f):
    """Appends in two requests to a log table."""
    path = tables.shared_folder(f.spark, "log")
    rows = f.events.select("event_id", (F.col("user_id") % 4).cast("long").alias("part"))
    half = (f.events.agg(F.max("event_id")).first()[0] or 0) // 2
    tables.append(f.spark, path, rows.where(F.col("event_id") <= half), "event_id")
    tables.append(f.spark, path, rows.where(F.col("event_id") > half), "event_id")
    return f.spark.read.parquet(path).select(F.col("part").cast("long").alias("part"), "off", "event_id")


_FOLDED = "select grp, generation from v_group"


@query("meta_snapshot", f"select 'groups' as frame, grp as name, generation as value from ({_FOLDED}) g union all select 'members', grp || '/' || member, null from v_member")
def _snapshot(f):
    """A snapshot of two frames restored; an older and an unfinished one beside it are passed over."""
    path = tables.shared_folder(f.spark, "snapshot")
    tables.snapshot(path, 1, {"groups": f.v_group.limit(0)})
    tables.snapshot(path, 2, {"groups": f.v_group, "members": f.v_member})
    f.v_group.limit(0).write.parquet(f"{path}/version=3/groups")
    found = tables.restore(f.spark, path)
    groups = found["groups"].select(F.lit("groups").alias("frame"), F.col("grp").alias("name"), F.col("generation").alias("value"))
    return groups.unionByName(found["members"].select(F.lit("members").alias("frame"), F.concat_ws("/", "grp", "member").alias("name"), F.lit(None).cast("long").alias("value")))


@query("meta_restore", "select name, value from v_meta where kind = 'topic' and off < 300")
def _restore(f):
    """A restore that may not go beyond a version takes the newest it supports."""
    path = tables.shared_folder(f.spark, "restore")
    topics = f.v_meta.where("kind = 'topic'").select("off", "name", "value")
    for version, until in ((1, 300), (2, 600)):
        tables.snapshot(path, version, {"topics": topics.where(F.col("off") < until)})
    return tables.restore(f.spark, path, 1)["topics"].select("name", "value")


@query("verify_exactly_once", "select part, count(*) as n, count(*) filter (where event_id % 50 = 7) as missing, count(*) filter (where event_id % 50 = 8) as duplicated, count(*) filter (where event_id % 50 = 9) as mismatches from v_log group by part")
def _exactly_once(f):
    """A sink that lost, repeated and changed known rows, held against its log."""
    sink = f.v_log.where("event_id % 50 <> 7").select("part", "off", F.when(F.col("event_id") % 50 == 9, "other").otherwise(F.upper("v")).alias("sink"), F.explode(F.when(F.col("event_id") % 50 == 8, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return control.verify_sink(f.v_log.select("part", "off", F.upper("v").alias("wanted")), sink)


# streams


@query("stream_seek", "select event_id, upper(event_type) as v from events where event_id >= 500")
def _seek(f):
    """Poll, transform and hand on from a position; the checkpoint holds what was polled."""
    return jobs.collected(jobs.from_position(jobs.events_stream(f.spark, f.dir, f.events.schema), "event_id", 500).select("event_id", F.upper("event_type").alias("v")), "append")


@query("idempotent_dedup", "select part, pid, seq, 1 as n, case when first then 'append' else 'out_of_order' end as verdict from (select user_id % 4 as part, event_id % 5 as pid, event_id as seq, row_number() over (partition by user_id % 4, event_id % 5 order by event_id) = 1 as first from events) t")
def _idempotent_dedup(f):
    """Sequences of five interleaved producers never continue one another, so all but the first are out of order."""
    rows = jobs.events_stream(f.spark, f.dir, f.events.schema).select((F.col("user_id") % 4).alias("part"), (F.col("event_id") % 5).alias("pid"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("n"))
    path = tables.shared_folder(f.spark, "dedup")
    jobs.dedup_sink(rows, path, tables.shared_folder(f.spark, "state")).awaitTermination()
    return f.spark.read.parquet(path).select("part", "pid", "seq", "n", "verdict")


@query("stream_sessions", "select min(ts) as start, user_id, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from (select *, case when ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes then 1 else 0 end as fresh from events) a) b group by user_id, session")
def _sessions(f):
    return jobs.collected(jobs.session_counts(jobs.events_stream(f.spark, f.dir, f.events.schema)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("stream_tumbling", "select date_trunc('hour', ts)::timestamptz at time zone 'UTC' as start, event_type, count(*) as n from events group by 1, 2")
def _tumbling(f):
    return jobs.collected(jobs.tumbling_counts(jobs.events_stream(f.spark, f.dir, f.events.schema)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _partitioned(f) -> str:
    """The log as files of a folder, for a stream of several micro-batches."""
    path = tables.shared_folder(f.spark, "feed")
    f.v_log.select("part", "off", "event_id", "v").repartitionByRange(3, "event_id").write.parquet(path)
    return path


def _positions(batch):
    return batch.groupBy("part").agg((F.max("off") + 1).alias("position")).withColumn("grp", F.lit("app"))


def _pipeline(f) -> str:
    feed, path = _partitioned(f), tables.shared_folder(f.spark, "pipeline")
    stream = f.spark.readStream.schema("part long, off long, event_id long, v string").option("maxFilesPerTrigger", 1).parquet(feed)
    jobs.transactional_sink(stream, path, tables.shared_folder(f.spark, "state"), _positions, lambda b: b.select("part", "off", F.upper("v").alias("v"))).awaitTermination()
    return path


@query("exactly_once_pipeline", "select part, off, upper(v) as v from v_log")
def _once(f):
    """Each micro-batch's rows and the offsets they came from commit together."""
    return tables.committed(f.spark, _pipeline(f), "rows").select("part", "off", "v")


@query("stream_commit", "select 'app' as grp, part, max(off) + 1 as position from v_log group by part")
def _commit(f):
    """Positions behind what was handed on, as committed by the poll loop."""
    positions = tables.committed(f.spark, _pipeline(f), "offsets")
    return positions.groupBy("grp", "part").agg(F.max("position").alias("position"))


@query("stream_poll_loop", "select part, count(*) as n, max(off) + 1 as position from v_log where off >= 100 group by part")
def _poll_loop(f):
    """Poll from a position, process, commit: the rows handed on and the position behind them."""
    feed = _partitioned(f)
    stream = f.spark.readStream.schema("part long, off long, event_id long, v string").option("maxFilesPerTrigger", 1).parquet(feed)
    polled = jobs.collected(jobs.from_position(stream, "off", 100), "append")
    return polled.groupBy("part").agg(F.count("*").alias("n"), (F.max("off") + 1).alias("position"))


@query("verify_segments", "select 'p' || part as folder, 1 as segments, count(distinct off // 10) as batches, count(*) as records, max(off) + 1 as next_off, null::varchar as problem from v_log group by part")
def _verify(f):
    """Segment files of each partition decoded batch by batch, checksums held, the first problem named."""
    return recordbatch.verify_batches(recordbatch.encoded(f.v_log.select("part", "off", F.lit(0).cast("long").alias("ts_ms"), F.lit(None).cast("binary").alias("key"), F.encode("v", "UTF-8").alias("value")), 10)).withColumn("folder", F.concat(F.lit("p"), "part")).drop("part")


query(
    "union_ordered",
    """select event_id, user_id % 3 as first, len(list_distinct([user_id % 3, event_id % 3, user_id % 5])) as n
    from events""",
)(
    lambda f: f.events.select("event_id", F.array_union(F.array((F.col("user_id") % 3)), F.array(F.col("event_id") % 3, F.col("user_id") % 5)).alias("u")).select("event_id", F.col("u")[0].alias("first"), F.size("u").alias("n"))
)
