"""Registered queries of the coordinators, the metadata log, codecs, tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import binary
from loglattice.operators import control, coordinator, groups, log, replication
from loglattice.plans.registry import query
from loglattice.sources import recordbatch, tables

# tables and codecs

_HALF = "(select max(event_id) / 2 from events)"
query("sink_append", f"select part, off, event_id from v_log where event_id > {_HALF}")(lambda f: _appended(f))
query(
    "scan_group_poll",
    """select 'm' || (l.part % 2) as member, l.part, l.off from (select *, row_number() over (partition by part order by off) as r
    from v_log where off >= 40 + part) l where r <= 25""",
)(
    lambda f: groups.group_poll(f.v_log.select("part", "off"), f.spark.sql("select concat('m', cast(id % 2 as string)) member, id part from range(4)"), f.spark.sql("select id part, 40 + id off from range(4)"), 25)
)
query(
    "codec_offsets_topic",
    """select grp, part, log_pos, '01' || printf('%04X', length(grp)) || hex(grp) || '0001' || hex('t') || printf('%08X', part) as key_hex, printf('%016X', committed) || '00000003' || '0000' || printf('%016X', log_pos) as value_hex
    from v_commit where committed is not null""",
)(
    lambda f: f.v_commit.where("committed is not null").select(
        "grp", "part", "log_pos", F.hex(binary.offset_key(F.col("grp"), F.lit("t"), F.col("part"))).alias("key_hex"), F.hex(binary.offset_value(F.col("committed"), F.lit(3), F.lit(None).cast("string"), F.col("log_pos"))).alias("value_hex")
    )
)
query("codec_offsets_topic_read", "select grp, 't' as topic, part, committed, log_pos as at_ms from v_commit where committed is not null")(lambda f: _read_back(f))
query(
    "codec_txn_topic",
    """select event_id, printf('%016X', event_id) || '00000002' || '01' || '0000EA60' || printf('%016X', event_id * 1000) || '00000001' || '0001' || hex('t') || printf('%08X', user_id % 4) as value_hex
    from events""",
)(
    lambda f: f.events.select("event_id", F.hex(binary.transaction_value(F.col("event_id"), F.lit(2), F.lit(1), F.lit(60000), F.col("event_id") * 1000, F.array(F.struct(F.lit("t").alias("topic"), (F.col("user_id") % 4).alias("part"))))).alias("value_hex"))
)
query("codec_batch", "select part, off, event_id::varchar as k, v from v_log")(lambda f: _through_batches(f))
query(
    "codec_txn_topic_read",
    """select event_id as pid, 2 as epoch, 1 as state, 60000 as timeout_ms, event_id * 1000 as at_ms, 2 as n
    from events""",
)(
    lambda f: f.events.select(binary.read_transaction_head(binary.transaction_value(F.col("event_id"), F.lit(2), F.lit(1), F.lit(60000), F.col("event_id") * 1000, F.array_repeat(F.struct(F.lit("t").alias("topic"), F.lit(1).alias("part")), 2))).alias("r")).select("r.*")
)
query(
    "varint",
    """select event_id, case when event_id % 2 = 0 then event_id * 5000 * 2 else event_id * 5000 * 2 - 1 end as zigzag, case when event_id = 0 then 1 else floor(log2(case when event_id % 2 = 0 then event_id * 5000 * 2 else event_id * 5000 * 2 - 1 end) / 7)::bigint + 1 end as size
    from events""",
)(
    lambda f: f.events.withColumn("x", F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 5000).otherwise(F.col("event_id") * -5000)).select("event_id", binary.zigzag_column(F.col("x")).alias("zigzag"), binary.varint_size(F.col("x")).alias("size"))
)
query("crc32c")(lambda f: f.events.select("event_id", binary.crc32c_column(F.encode("props", "UTF-8")).alias("crc")))


def _appended(f):
    """The later half of the events appended to the log of the earlier half."""
    rows = f.events.select("event_id", (F.col("user_id") % 4).alias("part"))
    half = f.events.agg((F.max("event_id") / 2).alias("half"))
    marked = rows.join(F.broadcast(half))  # one row
    ends = log.log_end_offset(log.assign_offsets(marked.where("event_id <= half"), "event_id"))
    return tables.appended(ends, marked.where("event_id > half"), "event_id").select("part", "off", "event_id")


def _through_batches(f):
    """The log as record batches of ten, zstd where smaller, and read again."""
    rows = f.v_log.select("part", "off", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("key"), F.encode("v", "UTF-8").alias("value"))
    return recordbatch.decoded(recordbatch.encoded(rows, 10, zstd=True)).select("part", "off", F.decode("key", "UTF-8").alias("k"), F.decode("value", "UTF-8").alias("v"))


def _read_back(f):
    rows = f.v_commit.where("committed is not null")
    coded = rows.select(binary.offset_key(F.col("grp"), F.lit("t"), F.col("part")).alias("key"), binary.offset_value(F.col("committed"), F.lit(-1), F.lit("m"), F.col("log_pos")).alias("value"))
    # no where() behind the reading: it would be pushed below and read every value again
    wanted = F.filter(F.array(binary.read_offset_value(F.col("value"))), lambda v: (v["epoch"] == -1) & (v["metadata"] == "m"))
    return coded.select(binary.read_offset_key(F.col("key")).alias("k"), F.inline(wanted)).select("k.grp", "k.topic", "k.part", "committed", "at_ms")


# the metadata log and the cluster

query(
    "meta_fold",
    """with d as (select name, max(off) as gone from v_meta where kind = 'delete_topic' group by name),
    t as (select m.name, min(m.off) as born from v_meta m left join d on d.name = m.name where kind = 'topic' and m.off > coalesce(gone, -1) group by m.name),
    p as (select m.*, row_number() over (partition by m.name, item order by leader_epoch desc, partition_epoch desc, off) as r from v_meta m left join d on d.name = m.name where kind = 'partition' and off > coalesce(gone, -1)),
    l as (select kind, name, item, value, row_number() over (partition by replace(kind, 'remove_', ''), name, case when kind = 'broker' then 0 else item end order by off desc) as r from v_meta where kind in ('acl', 'remove_acl', 'reassignment', 'broker'))
    select 'topic' as entity, m.name, null::bigint as item, arg_max(m.value, m.off) as value from v_meta m join t on t.name = m.name where m.kind in ('topic', 'config') and m.off >= t.born group by m.name
    union all select 'partition', name, item, value from p where r = 1
    union all select kind, name, case when kind <> 'broker' then item end, value from l where r = 1 and kind <> 'remove_acl' and (kind <> 'reassignment' or value is not null)
    union all select 'producer_id', null, null, max(value) from v_meta where kind = 'producer_id' having count(*) > 0""",
)(
    lambda f: control.meta_fold(f.v_meta)
)
query(
    "stream_commit_guard",
    """select event_id, case when user_id % 10 > 6 then 'UNKNOWN_MEMBER_ID' when event_id % 9 > user_id % 10 then 'FENCED_MEMBER_EPOCH' else 'NONE' end as error
    from events""",
)(
    lambda f: control.commit_guard(f.events.select("event_id", F.lit("g").alias("grp"), (F.col("user_id") % 10).alias("member"), (F.col("event_id") % 9).alias("epoch")), f.spark.range(7).select(F.lit("g").alias("grp"), F.col("id").alias("member"), F.col("id").alias("epoch"))).select("event_id", "error")
)
query(
    "disk_headroom_low",
    """select broker, sum(bytes)::bigint as usable, sum(bytes) < 3000 as low from v_sample
    group by broker""",
)(
    lambda f: control.disk_headroom_low(f.v_sample.groupBy("broker").agg(F.sum("bytes").alias("usable")), 3000)
)
query(
    "recover_offline",
    """select part, min(broker) as leader, part + 1 as epoch from v_replica where in_isr and broker in (2, 3)
    group by part""",
)(
    lambda f: control.recover_offline(f.v_replica.groupBy("part").agg(F.array_sort(F.collect_list(F.when(F.col("in_isr"), F.col("broker")))).alias("isr")).withColumn("epoch", F.col("part")), f.spark.range(2, 4).select(F.col("id").alias("broker")))
)
query(
    "plan_decommission",
    """select x as part, case when x % 2 = 0 then 4 else 5 end as replacement, false as refused
    from range(4) t(x)""",
)(
    lambda f: control.plan_decommission(f.v_replica.where("broker < 3").select("part", "broker"), f.spark.sql("select * from values (1L, 'a'), (2L, 'b'), (3L, 'b'), (4L, 'c'), (5L, 'd') as t(broker, rack)"), 1)
)
query(
    "stage_cooperative",
    """select member, case when c & (255 - t) = 0 then t else c & t end as held, case when c & (255 - t) = 0 or c & t = t then null else t end as pending,
    case when (case when c & (255 - t) = 0 then t else c & t end) <> c then 4 else 3 end as epoch from (select member, current_bits as c, target_bits as t from v_masks) m""",
)(lambda f: _staged(f))
query("same_set", "select member, current_bits = target_bits as same, current_bits | target_bits as either from v_masks")(
    lambda f: _sets(f).select("member", control.same_set(F.reverse("current"), F.col("target")).alias("same"), _bits(F.array_union("current", "target")).alias("either"))
)
query(
    "raft_commit_current_term",
    """select part, case when median(leo)::bigint >= part * 700 + 200 then median(leo)::bigint else -1 end as commit_index
    from v_replica group by part""",
)(
    lambda f: replication.raft_commit_index(f.v_replica.withColumnRenamed("leo", "match_index"), f.v_log.select("part").distinct().withColumn("start_off", F.col("part") * 700 + 200))
)
query(
    "high_watermark_floor",
    """select part, greatest(min(leo), part * 900) as hwm from v_replica where in_isr
    group by part""",
)(
    lambda f: replication.high_watermark(f.v_replica, f.v_log.select("part").distinct().withColumn("floor", F.col("part") * 900))
)
query(
    "offline_cluster",
    """select max(n) as n from (select broker, count(*) as n from v_replica where not in_isr
    group by broker) t""",
)(
    lambda f: f.v_replica.where("not in_isr").groupBy("broker").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
)
query("group_metadata_latest", "select grp, max(log_pos) as log_pos, arg_max(part, log_pos * 10 + part) as part from v_commit group by grp")(
    lambda f: f.v_commit.groupBy("grp").agg(F.max(F.struct("log_pos", "part")).alias("r")).select("grp", "r.log_pos", "r.part")
)


def _sets(f):
    array = lambda c: F.filter(F.sequence(F.lit(0), F.lit(7)), lambda p: F.expr(f"shiftright({c}, 0)").bitwiseAND(F.pow(F.lit(2), p).cast("long")) > 0)
    return f.v_masks.select("member", array("current_bits").alias("current"), array("target_bits").alias("target"))


def _bits(array):
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, p: a + F.pow(F.lit(2), p).cast("long"))


def _staged(f):
    rows = control.stage_cooperative(_sets(f).withColumn("epoch", F.lit(3)))
    return rows.select("member", _bits(F.col("held")).alias("held"), F.when(F.col("pending").isNotNull(), _bits(F.col("pending"))).alias("pending"), "epoch")


# coordinators

query(
    "committed_offsets_txn",
    """with s as (select *, min(case when event <> 'stage' then log_pos end) over (partition by coordinator, pid order by log_pos rows between current row and unbounded following) as decided from v_staged),
    c as (select s.grp, s.part, s.committed, s.log_pos, s.decided from s join v_staged m on m.coordinator = s.coordinator and m.pid = s.pid and m.log_pos = s.decided and m.event = 'commit' where s.event = 'stage')
    select grp, part, committed from (select *, row_number() over (partition by grp, part order by decided desc, log_pos desc) as r from c) t where r = 1""",
)(
    lambda f: coordinator.committed_offsets_txn(f.v_staged)
)
query(
    "txn_timeout",
    """select part * 10 + pid as txn_id, 'PREPARE_ABORT' as state, txn_no + 1 as epoch, last_off as at_ms
    from v_txn where outcome = 'OPEN' and 5000 - last_off > 100""",
)(
    lambda f: coordinator.txn_timeout(f.v_txn.select((F.col("part") * 10 + F.col("pid")).alias("txn_id"), F.when(F.col("outcome") == "OPEN", "ONGOING").otherwise("COMPLETE").alias("state"), F.col("txn_no").alias("epoch"), F.col("last_off").alias("at_ms")), 5000, 100)
)
query(
    "producer_lru",
    """select part, pid, off from (select part, pid, max(last_off) as off, row_number() over (partition by part order by max(last_off) desc, pid) as r
    from v_batch group by part, pid) t where r <= 3""",
)(
    lambda f: coordinator.producer_lru(f.v_batch.select("part", "pid", F.col("last_off").alias("off")), 3)
)

