"""Registered queries of the log operators, each beside an independent SQL oracle over the same fixture rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loglattice import catalog_control, catalog_sinks, catalog_state
from loglattice.operators import groups, log, metrics, replication, security, txn
from loglattice.plans.registry import oracle_sql, queries, query

__all__ = ["catalog_control", "catalog_sinks", "catalog_state", "oracle_sql", "queries"]

# scans, sources, sinks

query(
    "assign_offsets",
    """select part, off, event_id from v_log""",
)(
    lambda f: log.assign_offsets(f.events.withColumn("part", (F.col("user_id") % 4).cast("long")), "event_id").select("part", "off", "event_id")
)
query(
    "scan_offset_range",
    """select part, off, event_id from v_log where part = 1 and off >= 100 and off < 400""",
)(
    lambda f: log.scan_offset_range(f.v_log, 1, 100, 400).select("part", "off", "event_id")
)
query("scan_full", "select part, off, event_id, k, v from v_log")(lambda f: f.v_log.select("part", "off", "event_id", "k", "v"))
query("scan_records", "select part, off, k, v from v_tlog where not is_control")(lambda f: txn.filter_control(f.v_tlog).select("part", "off", "k", "v"))
query("scan_values", "select v from v_log")(lambda f: f.v_log.select("v"))
query(
    "scan_batches",
    """select part, batch_no, base_off, last_off, n from v_batch where last_off >= 705""",
)(
    lambda f: log.scan_batches(f.v_batch, 705).select("part", "batch_no", "base_off", "last_off", "n")
)
query(
    "segment_lookup",
    """select part, coalesce(max(case when segment_base <= 1234 then segment_base end), min(segment_base)) as segment_base
    from v_segment group by part""",
)(
    lambda f: log.segment_lookup(f.v_segment, 1234)
)
query("list_offsets", "select part, 0::bigint as earliest, max(off) + 1 as latest from v_log group by part")(lambda f: log.list_offsets(f.v_log))
query(
    "offset_for_timestamp",
    """select part, max(off) as off from v_log where ts <= timestamp '2024-01-10 00:00:00'
    group by part""",
)(
    lambda f: log.offset_for_timestamp(f.v_log, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
)
query("index_floor", "select part, max(base_off) as base_off from v_batch where base_off <= 777 group by part")(lambda f: log.index_floor(f.v_batch, 777))
query("source_feed", "select i, i % 3 as part from range(1000) t(i)")(lambda f: f.spark.range(1000).select(F.col("id").alias("i"), F.pmod("id", F.lit(3)).alias("part")))
query("source_events", "select event_id, event_type from events where event_id > 500")(lambda f: f.events.where("event_id > 500").select("event_id", "event_type"))
query(
    "sink_prometheus",
    """select broker, op, 'count' as metric, count(*) as value from v_sample group by all
    union all select broker, op, 'bytes', sum(bytes)::bigint from v_sample
    group by all""",
)(
    lambda f: f.v_sample.groupBy("broker", "op").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes")).unpivot(["broker", "op"], ["count", "bytes"], "metric", "value")
)
query(
    "verify_log",
    """select part, count(distinct floor(off / 500.0)) as segments, count(distinct floor(off / 10.0)) as batches, count(*) as records, max(off) + 1 as next_off, count(*) = max(off) - min(off) + 1 as dense
    from v_log group by part""",
)(
    lambda f: log.verify_log(f.v_log, 10, 500)
)
query(
    "recover_torn_tail",
    """select part, off from (select *, min(case when event_id % 997 = 5 then off end) over (partition by part) as bad
    from v_log) t where bad is null or off < bad""",
)(
    lambda f: log.recover_torn_tail(f.v_log, F.col("event_id") % 997 == 5).select("part", "off")
)

# projections and filters

query(
    "project_absolute_offset",
    """select part, base_off + unnest(range(n)) as off from v_batch""",
)(
    lambda f: f.v_batch.select("part", "base_off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("part", (F.col("base_off") + F.col("i")).alias("off"))
)
query(
    "project_deserialize",
    """select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""",
)(
    lambda f: f.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
)
query("filter_pre_offset", "select part, off from v_log where off >= 333")(lambda f: f.v_log.where("off >= 333").select("part", "off"))
query("filter_control", "select part, off, pid from v_tlog where not is_control")(lambda f: txn.filter_control(f.v_tlog).select("part", "off", "pid"))
query(
    "filter_paused",
    """select part, count(*) as n from v_log where part not in (2) group by part""",
)(
    lambda f: f.v_log.join(F.broadcast(f.spark.createDataFrame([(2,)], "part long")), "part", "left_anti").groupBy("part").agg(F.count("*").alias("n"))
)
query(
    "filter_read_committed",
    """with x as (select *, min(case when is_control then off end) over (partition by part, pid order by off rows between current row and unbounded following) as nm from v_tlog),
    l as (select part, least(coalesce(min(case when not is_control and pid > 0 and nm is null then off end), max(off) + 1), max(off) + 1) as lso from x group by part)
    select x.part, x.off, x.event_id from x join l on x.part = l.part left join v_tlog m on m.part = x.part and m.off = x.nm and m.is_control
    where not x.is_control and x.off < l.lso and (x.pid = 0 or m.marker = 'COMMIT')""",
)(lambda f: txn.filter_read_committed(f.v_tlog).select("part", "off", "event_id"))
_ACL = """select r.id, r.principal, r.rtype, r.rname, r.op, case when bool_or(not a.allow) then false when bool_or(a.allow) then true end as allowed
    from v_request r left join v_acl a on a.principal = r.principal and a.rtype = r.rtype and (a.op = '*' or a.op = r.op)
     and (a.rname = '*' or a.rname = r.rname or (a.is_prefix and starts_with(r.rname, a.rname))) group by all"""
query("acl_allows", _ACL)(lambda f: security.acl_allows(f.v_acl, f.v_request))
query(
    "acl_authorize",
    f"""with d as ({_ACL}) select id, principal = 'dave' or coalesce(allowed, false) as authorized
    from d""",
)(
    lambda f: security.acl_authorize(security.acl_allows(f.v_acl, f.v_request), ["dave"]).select("id", "authorized")
)
query(
    "liveness",
    """select broker, broker = 1 or date_diff('second', max(ts), timestamp '2024-03-01 00:00:00') <= 86400 as alive
    from v_sample group by broker""",
)(
    lambda f: f.v_sample.groupBy("broker").agg(((F.col("broker") == 1) | (F.unix_seconds(F.lit("2024-03-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.max("ts").cast("timestamp")) <= 86400)).alias("alive"))
)
query("pipeline_transform", "select event_id, upper(event_type) as v from events")(lambda f: f.events.select("event_id", F.upper("event_type").alias("v")))

# joins

_LAG = """with c as (select grp, part, committed from (select *, row_number() over (partition by grp, part order by log_pos desc) as rn from v_commit) t where rn = 1 and committed is not null),
    e as (select part, max(off) + 1 as leo from v_log where part < 3 group by part)
    select c.grp, c.part, c.committed, coalesce(e.leo, -1) as hwm, case when e.leo is null then -1 else greatest(e.leo - c.committed, 0) end as lag from c left join e on c.part = e.part"""
query("consumer_lag", _LAG)(lambda f: groups.consumer_lag(groups.committed_offsets(f.v_commit), log.log_end_offset(f.v_log.where("part < 3"))))
query(
    "aborted_txn_index",
    """select part, pid, first_off, last_off from (select t.part, t.pid, (select min(off)
    from v_tlog x where x.part = t.part and x.pid = t.pid and not x.is_control and x.off < t.off and x.off > coalesce((select max(off)
    from v_tlog y where y.part = t.part and y.pid = t.pid and y.is_control and y.off < t.off), -1)) as first_off, t.off as last_off
    from v_tlog t where t.is_control and t.marker = 'ABORT') z""",
)(
    lambda f: txn.aborted_txn_index(f.v_tlog)
)
query(
    "aborted_in_window",
    """with m as (select part, pid, off, marker, lag(off) over (partition by part, pid order by off) as before
    from v_tlog where is_control), a as (select m.part, m.pid, min(t.off) as first_off, m.off as last_off
    from m join v_tlog t on t.part = m.part and t.pid = m.pid and not t.is_control and t.off < m.off and t.off > coalesce(m.before, -1)
    where m.marker = 'ABORT' group by m.part, m.pid, m.off) select * from a
    where first_off < 900 and last_off >= 300""",
)(
    lambda f: txn.aborted_in_window(txn.aborted_txn_index(f.v_tlog), 300, 900)
)
query(
    "epoch_for_offset",
    """select l.part, l.off, max(e.epoch) as epoch from v_log l left join v_epoch e on e.part = l.part and e.start_off <= l.off
    group by l.part, l.off""",
)(
    lambda f: replication.epoch_for_offset(f.v_epoch, f.v_log.select("part", "off")).select("part", "off", "epoch")
)
query(
    "offsets_for_leader_epoch",
    """with n as (select part, epoch, lead(start_off) over (partition by part order by epoch) as next_start from v_epoch),
    r as (select p.part, q.req, max(e.epoch) as fe from (select distinct part from v_log) p cross join (values (-1::bigint), (0), (1), (2), (3), (9)) as q(req)
          left join v_epoch e on e.part = p.part and e.epoch <= q.req group by p.part, q.req),
    leo as (select part, max(off) + 1 as leo from v_log group by part)
    select r.part, r.req, case when r.fe is null then -1 else coalesce(n.next_start, leo.leo) end as end_offset from r join leo on leo.part = r.part left join n on n.part = r.part and n.epoch = r.fe""",
)(
    lambda f: replication.offsets_for_leader_epoch(f.v_epoch, log.log_end_offset(f.v_log), f.v_epoch.select("part").distinct().select("part", F.explode(F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1, 2, 3, 9)])).alias("req")))
)
query(
    "coordinator_route",
    """select distinct 'g' || g as grp, (103 * 31 + 48 + g) % 3 as part, case (103 * 31 + 48 + g) % 3 when 0 then 1::bigint when 1 then 2::bigint else -1::bigint end as leader
    from range(3) t(g)""",
)(
    lambda f: groups.coordinator_route(f.v_commit.select("grp").distinct(), f.spark.createDataFrame([(0, 1), (1, 2)], "part long, leader long"), 3)
)
query(
    "ledger_missing",
    """select event_id from events where event_id % 3 <> 0""",
)(
    lambda f: f.events.select("event_id").join(f.events.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti")
)
query(
    "ledger_duplicated",
    """select user_id, count(*) as n from events group by user_id having count(*) > 60""",
)(
    lambda f: f.events.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 60")
)
query(
    "under_replicated",
    """select part, count(*) filter (where in_isr) as isr, count(*) as n from v_replica
    group by part having count(*) filter (where in_isr) < count(*)""",
)(
    lambda f: metrics.under_replicated(f.v_replica)
)
query(
    "group_list_merge",
    """select grp, min(part) as part from v_commit group by grp""",
)(
    lambda f: f.v_commit.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("part", "log_pos"))).where("r = 1").select("grp", "part")
)

# aggregations

query("log_end_offset", "select part, max(off) + 1 as leo from v_log group by part")(lambda f: log.log_end_offset(f.v_log))
query(
    "compact_latest_by_key",
    """select l.part, l.off, l.k, l.v from v_log l left join (select part, k, max(off) as mo
    from v_log where k is not null group by part, k) m on l.part = m.part and l.k = m.k
    where l.k is null or (l.off = m.mo and l.v is not null)""",
)(
    lambda f: log.compact_latest_by_key(f.v_log).select("part", "off", "k", "v")
)
query("high_watermark", "select part, min(leo) as hwm from v_replica where in_isr group by part")(lambda f: replication.high_watermark(f.v_replica))
query(
    "hwm_history",
    """select part, off, max(event_id) over (partition by part order by off rows unbounded preceding) as hwm
    from v_log""",
)(
    lambda f: replication.hwm_history(f.v_log, "off", "event_id").select("part", "off", "hwm")
)
query(
    "last_stable_offset",
    """with x as (select *, min(case when is_control then off end) over (partition by part, pid order by off rows between current row and unbounded following) as nm
    from v_tlog) select part, least(coalesce(min(case when not is_control and pid > 0 and nm is null then off end), max(off) + 1), max(off) + 1) as lso
    from x group by part""",
)(
    lambda f: txn.last_stable_offset(f.v_tlog)
)
query(
    "aborted_evict",
    """select part, count(*) as n from v_txn where outcome = 'ABORT' and last_off >= 400
    group by part""",
)(
    lambda f: f.v_txn.where("outcome = 'ABORT' and last_off >= 400").groupBy("part").agg(F.count("*").alias("n"))
)
query(
    "committed_offsets",
    """select grp, part, committed from (select *, row_number() over (partition by grp, part order by log_pos desc) as rn
    from v_commit) t where rn = 1 and committed is not null""",
)(
    lambda f: groups.committed_offsets(f.v_commit)
)
query("newest_commit", "select grp, max(ts) as ts from v_commit group by grp")(lambda f: f.v_commit.groupBy("grp").agg(F.max("ts").alias("ts")))
query(
    "txn_state_latest",
    """select part, pid, arg_max(outcome, txn_no) as outcome from v_txn group by part, pid""",
)(
    lambda f: txn.latest_by(f.v_txn.select("part", "pid", "txn_no", "outcome"), ["part", "pid"], "txn_no").select("part", "pid", "outcome")
)
query(
    "producer_epoch_floor",
    """select part, pid, max(batch_no % 7) as epoch from v_batch group by part, pid""",
)(
    lambda f: txn.producer_epoch_floor(f.v_batch.withColumn("producer_epoch", F.col("batch_no") % 7))
)
query(
    "segment_stats",
    """select part, cast(floor(off / 500.0) as bigint) * 500 as segment_base, max(off) + 1 as next_off, sum(size_bytes)::bigint as size_bytes, count(*) as n
    from v_log group by 1, 2""",
)(
    lambda f: log.segment_stats(f.v_log, 500)
)
query(
    "throughput",
    """select broker, op, count(*) as n, sum(bytes)::bigint as bytes, round(greatest(0.001, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 3) as window_s, round(count(*) / greatest(0.001, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) as rate
    from v_sample group by broker, op""",
)(
    lambda f: metrics.throughput(f.v_sample)
)
query(
    "throughput_cluster",
    """with t as (select broker, op, count(*) as n, epoch_us(max(ts)) - epoch_us(min(ts)) as w
    from v_sample group by broker, op) select op, sum(n)::bigint as n, nullif(max(w), 0) as w
    from t group by op""",
)(
    lambda f: f.v_sample.groupBy("broker", "op").agg(F.count("*").alias("n"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("w")).groupBy("op").agg(F.sum("n").alias("n"), F.nullif(F.max("w"), F.lit(0).cast("long")).alias("w"))
)
query(
    "replica_load",
    """select broker, count(*) as n from v_replica group by broker""",
)(
    lambda f: replication.replica_load(f.v_replica.groupBy("part").agg(F.collect_list("broker").alias("replicas")))
)
query(
    "compact_fanout_total",
    """select sum(case when leo >= 300 then leo end)::bigint as kept, count(*) filter (where leo >= 300) as hosting
    from v_replica""",
)(
    lambda f: f.v_replica.agg(F.sum(F.when(F.col("leo") >= 300, F.col("leo"))).alias("kept"), F.count_if(F.col("leo") >= 300).alias("hosting"))
)
query(
    "raft_commit_index",
    """select part, median(leo)::bigint as commit_index from v_replica group by part""",
)(
    lambda f: replication.raft_commit_index(f.v_replica.withColumnRenamed("leo", "match_index"))
)
query(
    "partition_state_merge",
    """select part, pid as leader, le as leader_epoch, pe as partition_epoch from (select *, row_number() over (partition by part order by le desc, pe desc, batch_no) as rn
    from (select *, batch_no % 6 as le, batch_no % 4 as pe from v_batch) b) t
    where rn = 1""",
)(
    lambda f: replication.partition_state_merge(f.v_batch.select("part", F.col("pid").alias("leader"), (F.col("batch_no") % 6).alias("leader_epoch"), (F.col("batch_no") % 4).alias("partition_epoch"), F.col("batch_no").alias("seq")))
)

# windows

query(
    "epoch_lineage",
    """select part, min(off) as start_off, epoch from (select part, off, max(cast(floor(off / 300.0) as bigint)) over (partition by part order by off rows unbounded preceding) as epoch
    from v_log) t group by part, epoch""",
)(
    lambda f: replication.epoch_lineage(f.v_log.withColumn("leader_epoch", F.floor(F.col("off") / 300.0).cast("long")))
)
query(
    "diverged_tail",
    """select part, base_off, last_off from v_batch where last_off < 405""",
)(
    lambda f: log.diverged_tail(f.v_batch.select("part", "base_off", "last_off"), f.v_log.select("part").distinct().withColumn("end_offset", F.lit(405).cast("long")))
)
query(
    "retention_size",
    """select part, segment_base from (select *, coalesce(sum(size_bytes) over (partition by part order by segment_base rows between 1 following and unbounded following), -1) as later
    from v_segment) s where later < 8000""",
)(
    lambda f: log.retention_size(f.v_segment, 8000).select("part", "segment_base")
)
query(
    "retention_time",
    """select part, segment_base from (select *, max(keep) over (partition by part order by segment_base rows unbounded preceding) as kept
    from (select *, case when max_ts >= timestamp '2024-01-15 00:00:00' or lead(segment_base) over (partition by part order by segment_base) is null then 1 else 0 end as keep
    from v_segment) a) b where kept = 1""",
)(
    lambda f: log.retention_time(f.v_segment, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("part", "segment_base")
)
query(
    "fetch_byte_budget",
    """select part, base_off from (select *, sum(size_bytes) over (partition by part order by base_off) as s, row_number() over (partition by part order by base_off) as r
    from v_batch where last_off >= 200) t where s <= 900 or r = 1""",
)(
    lambda f: log.fetch_byte_budget(f.v_batch, 200, 900).select("part", "base_off")
)
query(
    "poll_max_records",
    """select part, count(*) as n, max(off) + 1 as position from (select part, off
    from v_log order by part, off limit 3500) t group by part""",
)(
    lambda f: log.poll_max_records(f.v_log.select("part", "off"), 3500)
)
query(
    "metric_delta_10m",
    """select broker, seq, latency_us - first_value(latency_us) over (partition by broker order by seq range between 600 preceding and current row) as delta
    from v_sample""",
)(
    lambda f: metrics.metric_delta(f.v_sample.select("broker", "seq", F.col("seq").alias("t"), F.col("latency_us").alias("value")), ["broker"], 600).select("broker", "seq", "delta")
)
query(
    "metric_ring",
    """select broker, seq from (select *, row_number() over (partition by broker order by seq desc) as r
    from v_sample) t where r <= 600""",
)(
    lambda f: metrics.metric_ring(f.v_sample, ["broker"], 600).select("broker", "seq")
)

# sorts, sets, scalars

query("order_offset", "select part, off from v_log order by part, off")(lambda f: f.v_log.select("part", "off").orderBy("part", "off"))
query("replay_after", "select event_id from events where event_id > 9000")(lambda f: f.events.where("event_id > 9000").select("event_id"))
_PARTITION = lambda f: f.v_replica.groupBy("part").agg(F.array_sort(F.collect_list("broker")).alias("replicas"), F.array_sort(F.collect_list(F.when(F.col("in_isr"), F.col("broker")))).alias("isr")).withColumns({"leader": F.col("part") % 3 + 1, "epoch": F.col("part")})
query(
    "pick_new_leader",
    """select part, case when part % 3 + 1 = 2 then coalesce(min(broker) filter (where in_isr and broker <> 2), -1) else part % 3 + 1 end as leader, part + case when part % 3 + 1 = 2 then 1 else 0 end as epoch
    from v_replica group by part""",
)(
    lambda f: replication.pick_new_leader(_PARTITION(f), 2).select("part", "leader", "epoch")
)
query(
    "preferred_leader",
    """select part, 1::bigint as leader, part + 1 as epoch from (select distinct part
    from v_replica) t where part % 3 + 1 <> 1""",
)(
    lambda f: replication.preferred_leader(_PARTITION(f))
)
query(
    "plan_reassignment",
    """select part, case when part % 2 = 0 then 'contract' else 'expand' end as step, case when part % 2 = 0 then '1,3' else '1,2,3' end as after
    from (select distinct part from v_log) t""",
)(
    lambda f: replication.plan_reassignment(_PARTITION(f).withColumn("target", F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))).select("part", "step", F.array_join(F.transform("after", lambda b: b.cast("string")), ",").alias("after"))
)
query(
    "fanout_union",
    """select broker, op from v_sample where broker = 1 union select broker, op
    from v_sample where broker > 1""",
)(
    lambda f: f.v_sample.where("broker = 1").select("broker", "op").union(f.v_sample.where("broker > 1").select("broker", "op")).distinct()
)
query(
    "set_intersect_except",
    """select user_id from events where event_type = 'click' intersect select user_id
    from events where event_type = 'view'""",
)(
    lambda f: f.events.where("event_type = 'click'").select("user_id").intersect(f.events.where("event_type = 'view'").select("user_id"))
)
query(
    "segment_name",
    """select distinct segment_base, lpad(segment_base::varchar, 20, '0') || '.log' as name
    from v_segment""",
)(
    lambda f: f.v_segment.select("segment_base").distinct().withColumn("name", F.concat(F.lpad(F.col("segment_base").cast("string"), 20, "0"), F.lit(".log")))
)
query(
    "java_string_hash",
    """select distinct grp, (103 * 31 + ascii(right(grp, 1)))::bigint as h from v_commit""",
)(
    lambda f: f.v_commit.select("grp").distinct().withColumn("h", groups.java_string_hash("grp"))
)
query(
    "check_batch_order",
    """select part, count(*) as n, 0::bigint as mismatches from v_log group by part""",
)(
    lambda f: f.v_log.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("off")) - 1).groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("r") != F.col("off")).alias("mismatches"))
)
query(
    "event_json",
    "select event_id, '{\"type\":\"' || event_type || '\",\"id\":' || event_id || '}' as payload from events",
)(
    lambda f: f.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id"))).alias("payload"))
)

# groups and streams in batch

query(
    "delete_group",
    """select grp, part, log_pos from v_commit where grp <> 'g1'""",
)(
    lambda f: f.v_commit.join(F.broadcast(f.spark.createDataFrame([("g1",)], "grp string")), "grp", "left_anti").select("grp", "part", "log_pos")
)
query(
    "reset_offsets",
    """select grp, part, case when grp = 'g0' then 0 else committed end as committed
    from (select *, row_number() over (partition by grp, part order by log_pos desc) as rn
    from v_commit) t where rn = 1 and (grp = 'g0' or committed is not null)""",
)(
    lambda f: groups.committed_offsets(f.v_commit.select("grp", "part", "log_pos", "committed").unionByName(f.v_commit.where("grp = 'g0'").select("grp", "part").distinct().withColumns({"log_pos": F.lit(1 << 40).cast("long"), "committed": F.lit(0).cast("long")})))
)
query("init_producer_id", "select max(pid) + 1 as next_id from v_batch")(lambda f: f.v_batch.agg((F.max("pid") + 1).alias("next_id")))
query(
    "tumbling_windows",
    """select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total
    from events group by 1, 2""",
)(
    lambda f: f.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
)

# plain relational breadth

query(
    "pricing_summary",
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by 1, 2""",
)(
    lambda f: f.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
)
query(
    "nation_revenue",
    """select n_name, round(sum(o_totalprice), 2) as revenue from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey group by 1""",
)(
    lambda f: f.orders.join(f.customer, F.col("o_custkey") == F.col("c_custkey")).join(f.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
)
query(
    "order_rollup",
    """select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)""",
)(
    lambda f: f.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
)
query(
    "top_orders",
    """select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r
    from orders) t where r <= 3""",
)(
    lambda f: f.orders.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("r <= 3").select("o_custkey", "o_orderkey")
)
