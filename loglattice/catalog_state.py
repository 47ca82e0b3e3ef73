"""Registered queries of replica liveness, placement, configuration, groups, gates and folds, each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.operators import control, coordinator, groups, log, metrics, replication, security, stateful, txn
from loglattice.plans.registry import query
from loglattice.sources import tables

# metrics

_LATENCY = """select broker, op, max(everything) as n,
    max(case when rn = cast(ceil(0.5 * c) as bigint) then latency_us end) as p50,
    max(case when rn = cast(ceil(0.99 * c) as bigint) then latency_us end) as p99,
    max(case when rn = cast(ceil(0.999 * c) as bigint) then latency_us end) as p999
  from (select *, row_number() over (partition by broker, op order by latency_us) as rn, count(*) over (partition by broker, op) as c
        from (select *, row_number() over (partition by broker, op order by seq desc) as recent,
                     count(*) over (partition by broker, op) as everything from v_sample) r where recent <= 1024) t group by broker, op"""


@query("latency_percentiles", _LATENCY)
def _latency(f):
    return metrics.latency_percentiles(f.v_sample)


@query("latency_cluster", f"with l as ({_LATENCY}) select op, max(p50) as p50, max(p99) as p99, max(p999) as p999 from l group by op")
def _latency_cluster(f):
    return metrics.latency_cluster(metrics.latency_percentiles(f.v_sample))


@query("sink_bench_csv", f"with l as ({_LATENCY}) select broker, op, n, p50, case when n >= 150 then p99 end as p99, 'local' as host from l")
def _bench_csv(f):
    """Percentile rows written as CSV and read again."""
    rows = tables.bench_rows(metrics.latency_percentiles(f.v_sample), 150, host="local").select("broker", "op", "n", "p50", "p99", "host")
    return tables.through_csv(rows)


@query(
    "partition_metrics",
    """with e as (select part, max(off) + 1 as leo from v_log group by part),
    h as (select part, min(leo) as hwm from v_replica where in_isr group by part)
    select r.part, e.leo, h.hwm, count(*) filter (where r.in_isr) as isr,
      string_agg(r.broker || ':' || greatest(e.leo - r.leo, 0), ',' order by r.broker) filter (where not r.is_leader) as lags
    from v_replica r join e on e.part = r.part left join h on h.part = r.part group by r.part, e.leo, h.hwm""",
)
def _partition_metrics(f):
    return metrics.partition_metrics(f.v_replica, log.log_end_offset(f.v_log), replication.high_watermark(f.v_replica))


_ALERTS = """with u as (select part, count(*) filter (where in_isr) as isr, count(*) as n from v_replica group by part),
    e as (select part, max(off) + 1 as leo from v_log group by part)
    select 'under_replicated' as alert, part::varchar as label, isr as value from u where isr < n
    union all select 'replication_lag_high', r.part || '/' || r.broker, e.leo - r.leo from v_replica r join e on e.part = r.part
      where not r.is_leader and e.leo - r.leo > 30
    union all select 'offline_partitions', 'cluster', count(*) from (select part from v_replica group by part having count(*) filter (where in_isr and broker > 2) = 0) o
      having count(*) > 0
    union all select 'disk_headroom_low', broker::varchar, sum(bytes)::bigint from v_sample group by broker having sum(bytes) < 100000"""


@query("alert_rules", _ALERTS)
def _alerts(f):
    alive = f.spark.range(3, 4).select(F.col("id").alias("broker"))
    states = f.v_replica.groupBy("part").agg(F.collect_list(F.when(F.col("in_isr"), F.col("broker"))).alias("isr"))
    usable = f.v_sample.groupBy("broker").agg(F.sum("bytes").alias("usable"))
    return metrics.alert_rules(f.v_replica, log.log_end_offset(f.v_log), control.offline_partitions(states, alive), control.disk_headroom_low(usable, 100000), 30)


@query(
    "alert_stalled",
    """with h as (select part, seq, max(floor(seq / 2000)) over (partition by part order by seq) as hwm from (select user_id % 4 as part, event_id as seq from events) e)
    select part, seq from (select *, hwm - first_value(hwm) over (partition by part order by seq range between 600 preceding and current row) as delta from h) d
    where delta = 0 and seq > hwm""",
)
def _stalled(f):
    """The high watermark stands still behind the log end over a whole window."""
    series = f.events.select((F.col("user_id") % 4).alias("part"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 2000).alias("value"))
    return metrics.stalled(series.withColumns({"t": F.col("seq"), "leo": F.col("seq")}), ["part"], 600).select("part", "seq")


# replicas

query("laggards", "select part, broker from v_follow where not is_leader and (last_fetch is null or last_fetch < 90000)")(
    lambda f: replication.laggards(f.v_follow.where("not is_leader"), 100000, 10000).select("part", "broker")
)


@query(
    "isr_shrink_expand",
    """with r as (select *, in_isr and not is_leader and (coalesce(last_fetch < 90000, false)
                or (last_fetch is null and 100000 - coalesce(first_seen, 100000) >= 10000)) as goes from v_follow),
    h as (select part, case when count(*) filter (where not is_leader and last_fetch is null) > 0 then 0 else min(leo) end as hwm from v_follow where in_isr group by part),
    m as (select r.*, not in_isr and not is_leader and last_fetch is not null and leo >= hwm as comes from r join h on h.part = r.part)
    select part, string_agg(broker::varchar, ',' order by comes, broker) filter (where (in_isr and not goes) or comes) as isr
    from m group by part having bool_or(goes or comes)""",
)
def _isr(f):
    return replication.isr_shrink_expand(f.v_follow, 100000, 10000)


@query(
    "place_replicas",
    """with b as (select *, max(case when seat = 1 then rack end) over () as anchor from v_broker), o as (select * from b where seat > 1),
    k as (select rack, row_number() over (order by rack = '', rack) - 1 as i, count(*) over () as m from (select distinct rack from o) d),
    s as (select coalesce(max(i), -1) + 1 as start from k join (select distinct anchor from b) a on k.rack = a.anchor),
    q as (select o.*, k.i, k.m, s.start, row_number() over (partition by o.rack order by load, broker) as turn from o join k on k.rack = o.rack cross join s),
    p as (select broker, rack, 1 + row_number() over (order by turn, (i - start + m) % m) as place from q)
    select 1::bigint as place, broker, rack from b where seat = 1 union all select place, broker, rack from p where place <= 6""",
)
def _place(f):
    return replication.place_replicas(f.v_broker, 6)


query("offline_partitions", "select part from v_replica group by part having count(*) filter (where in_isr and broker > 2) = 0")(
    lambda f: control.offline_partitions(
        f.v_replica.groupBy("part").agg(F.collect_list(F.when(F.col("in_isr"), F.col("broker"))).alias("isr")), f.spark.range(3, 4).select(F.col("id").alias("broker"))
    )
)


@query(
    "hwm_overlay",
    """select part, coalesce(max_by(leo, broker) filter (where leo >= 0 and not (part = 2 and broker = 3)), -1) as hwm from v_replica group by part""",
)
def _overlay(f):
    """Brokers answer in the order of their ids, and broker 3 does not know the end of partition 2."""
    told = f.v_replica.select("part", F.col("broker").alias("seq"), F.when((F.col("part") == 2) & (F.col("broker") == 3), -1).otherwise(F.col("leo")).alias("hwm"))
    return metrics.hwm_overlay(told)


# configuration and gates


@query("flag_bits", "select event_id, (event_id & 8) > 0 as control, (event_id & 16) > 0 as transactional, event_id & 7 as codec from events")
def _flags(f):
    from loglattice.functions.binary import flag_bits

    return f.events.select("event_id", *flag_bits(F.col("event_id")))


_INTEGER = "case when name in ('min.insync.replicas', 'max.message.bytes') then try_cast(trim(raw) as integer)::bigint else try_cast(trim(raw) as bigint) end"


@query(
    "validate_config",
    f"""with s as (select *, {_INTEGER} as x from v_setting)
    select event_id, name as key, case when raw is null or name = 'other' then 'ok' when x is null then 'not_integer'
      when name in ('retention.ms', 'retention.bytes', 'flush.messages', 'flush.ms') then case when x <> -1 and x < 1 then 'too_small' else 'ok' end
      when x < (case name when 'segment.bytes' then 1024 else 1 end) then 'too_small'
      when x > (case name when 'segment.bytes' then 1073741824 when 'max.message.bytes' then 8388608 else rf end) then 'too_large' else 'ok' end as verdict from s""",
)
def _validate(f):
    return security.validate_config(f.v_setting.withColumnRenamed("name", "key")).select("event_id", "key", "verdict")


@query(
    "effective_config",
    f"""with s as (select *, {_INTEGER} as x from v_setting)
    select event_id, case when name = 'min.insync.replicas' and x is not null then greatest(1, x) else greatest(1, least(2, rf)) end as min_isr,
      case when name = 'max.message.bytes' and x is not null then greatest(1, x) else 1000000 end as message,
      greatest(1024, case when name = 'segment.bytes' and x is not null then x else 500 end) as segment,
      case when name = 'retention.ms' and x is not null then x else 604800000 end as retention from s""",
)
def _effective(f):
    out = f.v_setting.select("event_id", "rf", F.create_map("name", "raw").alias("config"))
    for name, key, default in (("min_isr", security.MIN_ISR, 2), ("message", security.MESSAGE, 1000000), ("segment", security.SEGMENT, 500), ("retention", "retention.ms", 604800000)):
        out = security.effective_config(out, key, default).withColumnRenamed("value", name)
    return out.drop("rf", "config")


_GATE = """case when user_no = 4 then 13 when size > 900 and user_no = 0 then 86 when part > 4 then 2 when size > 1000 then 11
      when not leads then 5 when acks = -1 and isr < 2 then 9 when corrupt or control then 3 else 0 end"""


def _gates(f):
    """The gates of a produce request in their order, the topic's and the cluster's state as columns of the request."""
    return control.produce_errors(
        f.v_request_batch.select(
            "event_id", "part", (F.col("user_no") != 4).alias("authorized"), ((F.col("size") <= 900) | (F.col("user_no") != 0)).alias("in_quota"), F.lit(True).alias("known_topic"), F.lit(5).alias("partitions"),
            "size", F.lit(1000).alias("max_bytes"), F.lit(False).alias("disk_low"), "leads", "acks", "isr", F.lit(2).alias("min_isr"), "corrupt", "control",
        )
    )


query("produce_gate", f"select event_id, {_GATE} as error from v_request_batch")(lambda f: _gates(f).select("event_id", "error"))
query(
    "sink_produce",
    f"""select part, row_number() over (partition by part order by event_id) - 1 as off, event_id
    from v_request_batch where ({_GATE}) = 0""",
)(
    lambda f: tables.appended(f.spark.createDataFrame([], "part long, leo long"), _gates(f).where("error = 0").select("part", "event_id"), "event_id").select("part", "off", "event_id")
)
query("filter_partial_tail", "select part, batch_no from (select *, sum(size_bytes) over (partition by part order by base_off) as stop from v_batch) b where stop <= 4000")(
    lambda f: log.filter_partial_tail(f.v_batch, 4000).select("part", "batch_no")
)

# transactions and groups

query(
    "pending_markers",
    """select s.txn_id, p.topic, p.part, s.pid, s.epoch, s.state = 'PREPARE_COMMIT' as commit
    from v_txnstate s join v_txnpart p on p.txn_id = s.txn_id where s.state like 'PREPARE%'""",
)(
    lambda f: txn.pending_markers(f.v_txnstate, f.v_txnpart)
)
query(
    "producer_state",
    """select part, pid, batch_no // 40 as epoch, max(batch_no) as sequence, max_by(last_off, batch_no) as last_off
    from v_batch group by part, pid, batch_no // 40""",
)(
    lambda f: txn.producer_state(f.v_batch.select("part", "pid", F.floor(F.col("batch_no") / 40).alias("epoch"), F.col("batch_no").alias("sequence"), "last_off"))
)
query(
    "group_summary",
    """select g.grp, case when count(m.member) = 0 then 'Empty' else 'Stable' end as state, count(m.member) as members, g.generation,
      (103 * 31 + ascii(right(g.grp, 1))) % 50 as part from v_group g left join v_member m on m.grp = g.grp group by g.grp, g.generation""",
)(lambda f: groups.group_summary(f.v_group, f.v_member, 50))
_OWNER = "select grp, cast(row_number() over (partition by grp order by member) - 1 as bigint) as part, member from v_member"
query(
    "describe_group",
    f"""with o as ({_OWNER}), c as (select grp, part, committed from (select *, row_number() over (partition by grp, part order by log_pos desc) as r from v_commit) t where r = 1 and committed is not null),
    e as (select part, max(off) + 1 as leo from v_log where part < 3 group by part)
    select c.grp, c.part, c.committed, coalesce(e.leo, -1) as hwm, case when e.leo is null then -1 else greatest(e.leo - c.committed, 0) end as lag, coalesce(o.member, '') as owner
    from c left join e on e.part = c.part left join o on o.grp = c.grp and o.part = c.part""",
)(
    lambda f: groups.describe_group(
        f.spark.sql(_OWNER.replace("v_member", "{v_member}"), v_member=f.v_member), groups.committed_offsets(f.v_commit), log.log_end_offset(f.v_log.where("part < 3"))
    )
)
query(
    "offset_expiry",
    """select grp, max(ts) as newest from v_commit where (grp <> 'g2' or ts < timestamp '2024-01-20 00:00:00') and grp not in (select grp from v_member where grp = 'g0')
    group by grp having max(ts) <= timestamp '2024-01-25 00:00:00'""",
)(
    lambda f: groups.offset_expiry(f.v_commit.where("grp <> 'g2' or ts < timestamp_ntz '2024-01-20 00:00:00'"), f.v_member.where("grp = 'g0'"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
)


@query(
    "session_eviction",
    """select grp, member, last_at from (select grp, member, event_id as last_at, lead(event_id) over (partition by grp, member order by event_id) as following,
        (select max(event_id) from events) as now from v_session) s where coalesce(following, now) - last_at > 150""",
)
def _eviction(f):
    """Members unheard of for longer than the session's time, at their last sign before it."""
    now = f.events.agg(F.max("event_id").alias("now"))
    return groups.session_eviction(f.v_session.select("grp", "member", F.col("event_id").alias("at")), now, 150).withColumnRenamed("at", "last_at")


# folds: the oracle recurses over the rows of a key


def _recursive(source: str, key: str, order: str, first: str, following: str, wanted: str) -> str:
    """SQL that walks each key's rows: ``first`` and ``following`` are select lists of the state, over o (row) and s (state before)."""
    return f"""with recursive o as materialized (select *, row_number() over (partition by {key} order by {order}) as r from ({source}) x),
    s as (select o.*, {first} from o where o.r = 1
          union all select o.*, {following} from s join o on {' and '.join(f'o.{k.strip()} = s.{k.strip()}' for k in key.split(','))} and o.r = s.r + 1)
    select {wanted} from s"""


_SEQUENCES = "select part, pid, batch_no // 50 as epoch, batch_no, row_number() over (partition by part, pid, batch_no // 50 order by batch_no) - case when batch_no % 13 = 0 then 1 else 0 end as seq, 1::bigint as n from v_batch"
_FITS = "o.seq = s.last_seq + s.last_n"


@query(
    "dedup_sequence",
    _recursive(
        _SEQUENCES, "part, pid, epoch", "batch_no", "o.seq as last_seq, o.n as last_n, 'append' as verdict",
        f"""case when {_FITS} then o.seq else s.last_seq end, case when {_FITS} then o.n else s.last_n end,
        case when {_FITS} then 'append' when o.seq = s.last_seq and o.n = s.last_n then 'cached' else 'out_of_order' end""",
        "part, pid, epoch, batch_no, verdict",
    ),
)
def _dedup(f):
    from pyspark.sql import Window

    own = Window.partitionBy("part", "pid", "epoch").orderBy("batch_no")
    rows = f.v_batch.select("part", "pid", F.floor(F.col("batch_no") / 50).alias("epoch"), "batch_no")
    rows = rows.withColumns({"seq": (F.row_number().over(own) - F.when(F.col("batch_no") % 13 == 0, 1).otherwise(0)).cast("long"), "n": F.lit(1).cast("long")})
    return stateful.folded(rows, ["part", "pid", "epoch"], ["batch_no"], ["seq", "n"], stateful.dedup_steps, "verdict", "string").drop("seq", "n")


@query("batch_seal", _recursive("select part, off, size_bytes from v_log", "part", "off", "0::bigint as batch, o.size_bytes as total", "s.batch + case when s.total >= 200 then 1 else 0 end, case when s.total >= 200 then 0 else s.total end + o.size_bytes", "part, off, size_bytes, batch"))
def _seal(f):
    return stateful.folded(f.v_log.select("part", "off", "size_bytes"), ["part"], ["off"], ["off", "size_bytes"], lambda r: stateful.seal_steps(r, 200, 1 << 40), "batch", "long")


@query("segment_roll", _recursive("select part, base_off, size_bytes from v_batch", "part", "base_off", "0::bigint as segment, o.size_bytes as total", "s.segment + case when s.total >= 800 then 1 else 0 end, case when s.total >= 800 then 0 else s.total end + o.size_bytes", "part, base_off, size_bytes, segment"))
def _roll(f):
    return stateful.folded(f.v_batch.select("part", "base_off", "size_bytes"), ["part"], ["base_off"], ["size_bytes"], lambda r: stateful.roll_steps(r, 800), "segment", "long")


_REFILLED = "least(2000.0::double, s.tokens + 2000.0::double * (o.seq - s.seq) / 1000)"


@query(
    "token_bucket",
    _recursive(
        "select broker, seq, bytes from v_sample", "broker", "seq", "2000.0::double - o.bytes as tokens, 0::bigint as wait_ms",
        f"""case when o.bytes <= {_REFILLED} then {_REFILLED} - o.bytes else {_REFILLED} end,
        case when o.bytes <= {_REFILLED} then 0 else greatest(1, ceil((o.bytes - {_REFILLED}) / 2000.0::double * 1000)::bigint) end""",
        "broker, seq, bytes, wait_ms",
    ),
)
def _bucket(f):
    return stateful.folded(f.v_sample.select("broker", "seq", "bytes"), ["broker"], ["seq"], ["seq", "bytes"], lambda r: stateful.bucket_steps(r, 2000.0), "wait_ms", "long")


_MORE = "case when o.seq > s.seq then least(2000.0::double, s.tokens + 2000.0::double * (o.seq - s.seq) / 1000) else s.tokens end"


@query(
    "throttle_grant",
    _recursive(
        "select broker, seq, bytes from v_sample", "broker", "seq", "0.0::double as tokens, 0::bigint as granted",
        f"({_MORE}) - greatest(0, least(o.bytes, floor({_MORE})::bigint)), greatest(0, least(o.bytes, floor({_MORE})::bigint))", "broker, seq, bytes, granted",
    ),
)
def _grant(f):
    return stateful.folded(f.v_sample.select("broker", "seq", "bytes"), ["broker"], ["seq"], ["seq", "bytes"], lambda r: coordinator.grant_steps(r, 2000.0, 2000.0), "granted", "long")


_EVENTS = """select part * 10 + pid as txn_id, batch_no, case when batch_no // 5 % 4 = 3 then 'commit' when batch_no // 5 % 4 = 0 and batch_no > 20 then 'markers' when batch_no // 5 % 17 = 5 then 'init' else 'add' end as event,
    batch_no // 60 as epoch from v_batch"""
_STEP = """case when o.epoch < s.at_epoch then s.state when o.event = 'init' then case when s.state = 'ONGOING' then 'PREPARE_ABORT' else s.state end
    when o.event = 'add' and s.state in ('EMPTY', 'ONGOING', 'COMPLETE_COMMIT', 'COMPLETE_ABORT') then 'ONGOING' when o.event = 'commit' and s.state = 'ONGOING' then 'PREPARE_COMMIT'
    when o.event = 'markers' and s.state = 'PREPARE_COMMIT' then 'COMPLETE_COMMIT' when o.event = 'markers' and s.state = 'PREPARE_ABORT' then 'COMPLETE_ABORT' else s.state end"""
_MOVED = """(o.event = 'add' and s.state in ('EMPTY', 'ONGOING', 'COMPLETE_COMMIT', 'COMPLETE_ABORT')) or (o.event = 'commit' and s.state = 'ONGOING') or (o.event = 'markers' and s.state like 'PREPARE%')"""
_EMPTY = "(select 'EMPTY' as state, 0::bigint as at_epoch) s"


@query(
    "txn_fsm",
    f"""with recursive o as materialized (select *, row_number() over (partition by txn_id order by batch_no) as r from ({_EVENTS}) x),
    t as (select txn_id, 0::bigint as batch_no, 0::bigint as r, 'EMPTY' as state, 0::bigint as at_epoch from (select distinct txn_id from o) k
      union all select o.txn_id, o.batch_no, o.r, {_STEP}, case when o.epoch < s.at_epoch then s.at_epoch when o.event = 'init' then o.epoch + 1 when {_MOVED} then o.epoch else s.at_epoch end
      from t s join o on o.txn_id = s.txn_id and o.r = s.r + 1)
    select txn_id, batch_no, state from t where r > 0""",
)
def _fsm(f):
    number = F.floor(F.col("batch_no") / 5)
    event = F.when(number % 4 == 3, "commit").when((number % 4 == 0) & (F.col("batch_no") > 20), "markers").when(number % 17 == 5, "init").otherwise("add")
    rows = f.v_batch.select((F.col("part") * 10 + F.col("pid")).alias("txn_id"), "batch_no", event.alias("event"), F.floor(F.col("batch_no") / 60).alias("epoch"))
    return stateful.folded(rows, ["txn_id"], ["batch_no"], ["event", "epoch"], lambda r: (state for state, _ in stateful.txn_steps(r)), "state", "string").drop("event", "epoch")


@query(
    "partition_change_cas",
    _recursive(
        "select part, batch_no, batch_no - case when batch_no % 9 = 4 then 2 else 0 end as prior, batch_no + 1 as new, pid from v_batch", "part", "batch_no",
        "o.prior = 0 as applied, case when o.prior = 0 then o.new else 0 end as current", "o.prior = s.current, case when o.prior = s.current then o.new else s.current end", "part, batch_no, prior, new, pid, applied",
    ),
)
def _cas(f):
    rows = f.v_batch.select("part", "batch_no", (F.col("batch_no") - F.when(F.col("batch_no") % 9 == 4, 2).otherwise(0)).alias("prior"), (F.col("batch_no") + 1).alias("new"), "pid")
    return stateful.folded(rows, ["part"], ["batch_no"], ["prior", "new", "pid"], stateful.cas_steps, "applied", "boolean")


@query(
    "sink_append_raw",
    _recursive(
        "select part, batch_no, base_off - case when batch_no % 9 = 5 then 3 else 0 end as base_off, last_off from v_batch", "part", "batch_no",
        "case when o.base_off >= 0 then 'append' else 'rejected' end as outcome, case when o.base_off >= 0 then o.last_off + 1 else 0 end as log_end",
        "case when o.base_off >= s.log_end then 'append' else 'rejected' end, case when o.base_off >= s.log_end then o.last_off + 1 else s.log_end end",
        "part, batch_no, base_off, last_off, outcome",
    ),
)
def _raw(f):
    rows = f.v_batch.select("part", "batch_no", (F.col("base_off") - F.when(F.col("batch_no") % 9 == 5, 3).otherwise(0)).alias("base_off"), "last_off")
    return stateful.folded(rows, ["part"], ["batch_no"], ["base_off", "last_off"], coordinator.raw_append_steps, "outcome", "string")


query(
    "txn_marker_apply",
    """with recursive o as materialized (select part, off, pid, case when not is_control then 'data' when marker = 'COMMIT' then 'commit' else 'abort' end as event, off % 3 as ce,
        row_number() over (partition by part order by off) as r from v_tlog),
    t as (select part, 0::bigint as r, 0::bigint as seq, '' as outcome, -1::bigint as off, 0::bigint as log_end, map {}::map(bigint, struct(event varchar, ce bigint, place bigint)) as last from (select distinct part from o) k
      union all select part, r, seq, outcome, case outcome when 'refused' then -1 when 'repeated' then last[pid].place else log_end end, log_end + case when outcome = 'appended' then 1 else 0 end,
        case when outcome = 'appended' and event <> 'data' then map_concat(last, map {pid: {'event': event, 'ce': ce, 'place': log_end}}) else last end
      from (select o.part, o.r, o.off as seq, o.event, o.pid, o.ce, s.log_end, s.last,
              case when o.event = 'data' then 'appended' when s.last[o.pid].ce > o.ce then 'refused'
                when s.last[o.pid].event = o.event and s.last[o.pid].ce = o.ce and s.last[o.pid].place = s.log_end - 1 then 'repeated' else 'appended' end as outcome
            from t s join o on o.part = s.part and o.r = s.r + 1) n)
    select part, seq, outcome, off from t where r > 0""",
)(
    lambda f: coordinator.marker_log(
        f.v_tlog.select("part", F.col("off").alias("seq"), F.when(~F.col("is_control"), "data").when(F.col("marker") == "COMMIT", "commit").otherwise("abort").alias("event"), "pid", F.lit(0).cast("long").alias("epoch"), (F.col("off") % 3).alias("coordinator_epoch"))
    )
)


def _lifecycle(f):
    empty = F.array().cast("array<bigint>").alias("owned")
    return coordinator.group_lifecycle(
        f.events.select(
            (F.col("user_id") % 5).alias("grp"), F.col("event_id").alias("seq"), (F.col("event_id") * 100).alias("at_ms"), F.when(F.col("event_id") % 11 == 0, "leave").when(F.col("event_id") % 5 == 1, "join").otherwise("heartbeat").alias("event"),
            F.concat(F.lit("m"), F.col("user_id") % 7).alias("member"), F.when(F.col("user_id") % 7 < 2, F.concat(F.lit("i"), F.col("user_id") % 7)).otherwise("").alias("instance"), F.lit(0).cast("long").alias("epoch"), empty,
        ), 12, 20000,
    )


# a member's two-step moves are the whole machine again in SQL: the test replays them in plain Python
query("group_join_heartbeat_leave")(_lifecycle)
query("static_membership")(lambda f: _lifecycle(f).where("outcome = 'rejoined'").select("grp", "seq", "member", "generation"))


# assignment, tokens and small metadata

query(
    "assign_range",
    """with s as (select m.topic, m.member, row_number() over (partition by m.topic order by member) - 1 as i, count(*) over (partition by m.topic) as c, n
      from v_subscriber m join v_topic p on p.topic = m.topic)
    select topic, member, x as part from s, range(100) t(x) where x < n and x >= i * (n // c) + least(i, n % c) and x < (i + 1) * (n // c) + least(i + 1, n % c)""",
)(lambda f: groups.assign_range(f.v_subscriber, f.v_topic))
query(
    "assign_uniform",
    """with m as (select distinct member from v_subscriber), s as (select member, row_number() over (order by member) - 1 as i, count(*) over () as c from m),
    t as (select topic, x as part, row_number() over (order by topic, x) - 1 as k from v_topic, range(100) r(x) where x < n)
    select t.topic, s.member, t.part from t join s on t.k % s.c = s.i""",
)(lambda f: groups.assign_uniform(f.v_subscriber, f.v_topic))
query(
    "assign_uniform_mixed",
    """with recursive p as materialized (select topic, x as part, row_number() over (order by topic, x) as k from v_topic, range(100) r(x) where x < n),
    m as materialized (select member, row_number() over (order by member) - 1 as i, count(*) over () as c from (select distinct member from v_subscriber) d),
    w as (select 0::bigint as k, 0::bigint as turn, ''::varchar as topic, 0::bigint as part, ''::varchar as member
      union all select p.k, coalesce((b.i + 1) % b.c, w.turn), p.topic, p.part, coalesce(b.member, '')
      from w join p on p.k = w.k + 1 left join lateral (select m.* from m join v_subscriber s on s.member = m.member and s.topic = p.topic
        order by (m.i - w.turn + m.c) % m.c limit 1) b on true)
    select topic, part, member from w where member <> ''""",
)(lambda f: coordinator.assign_uniform_mixed(f.v_subscriber, f.v_topic))
query("member_topic_match", "select distinct t.topic, m.member from v_topic t join v_subscriber m on m.topic = t.topic where t.n > 4")(
    lambda f: groups.member_topic_match(f.v_subscriber.groupBy("member").agg(F.collect_set("topic").alias("topics")), f.v_topic.where("n > 4"))
)
query(
    "assignment_diff",
    """with a as (select distinct 't' as topic, 'm' || user_id % 9 as member, event_id % 997 as part from events where event_id % 3 <> 0),
    b as (select distinct 't' as topic, 'm' || user_id % 9 as member, event_id % 997 as part from events where event_id % 3 <> 1)
    select *, 'revoked' as change from (select * from a except select * from b) x union all select *, 'added' from (select * from b except select * from a) y""",
)(lambda f: groups.assignment_diff(*(_owned(f).where(F.col("event_id") % 3 != k).drop("event_id").distinct() for k in (0, 1))))


def _owned(f):
    return f.events.select("event_id", F.lit("t").alias("topic"), F.concat(F.lit("m"), F.col("user_id") % 9).alias("member"), (F.col("event_id") % 997).alias("part"))


_TOKEN = "case event_id % 7 when 0 then 'x' when 1 then '' when 2 then user_id || ' s' else user_id || substr('smhd', cast(event_id % 4 + 1 as int), 1) end"
query(
    "duration_token",
    f"""select event_id, case when regexp_matches(t, '^[0-9]+[smh]$') then (left(t, length(t) - 1))::bigint * case right(t, 1) when 's' then 1 when 'm' then 60 else 3600 end
      else 300 end::bigint as seconds from (select event_id, {_TOKEN} as t from events) d""",
)(lambda f: f.events.selectExpr("event_id", f"{_TOKEN} as t").select("event_id", security.duration_seconds(F.col("t")).cast("long").alias("seconds")))
query("host_port_parse", "select event_id, 'b' || user_id || '.' || event_type as host, event_id % 65536 as port from events")(
    lambda f: f.events.select("event_id", security.host_port(F.format_string("b%d.%s:%d", "user_id", "event_type", F.col("event_id") % 65536))).select("event_id", "hp.host", "hp.port")
)
query("backoff_schedule", "select event_id, least(50 * pow(2, event_id % 12), 1000)::bigint as ms from events")(
    lambda f: f.events.select("event_id", metrics.backoff_ms(F.col("event_id") % 12, 50, 1000).alias("ms"))
)
query(
    "health_badge",
    """select part, case when part % 3 = 2 or alive < floor(n / 2.0) + 1 then 'red' when alive < n then 'yellow' else 'green' end as badge
    from (select part, count(*) as n, count(*) filter (where in_isr) as alive from v_replica group by part) c""",
)(
    lambda f: metrics.health_badge(f.v_replica.groupBy("part").agg(F.count("*").alias("n"), F.count_if("in_isr").alias("alive")).withColumn("has_controller", F.col("part") % 3 != 2)).select("part", "badge")
)
query(
    "config_merge",
    """select event_id, string_agg(k || '=' || v, ',' order by k) as merged from (
      select event_id, 'a' as k, (user_id % 5)::varchar as v from events union all select event_id, 'b', case when event_id % 2 = 0 then 'own' else 'default' end from events
      union all select event_id, 'c', 'own' from events where event_id % 3 = 0) x group by event_id""",
)(
    lambda f: f.events.select(
        "event_id", F.create_map(F.lit("a"), (F.col("user_id") % 5).cast("string"), F.lit("b"), F.lit("default")).alias("x"),
        F.map_filter(F.create_map(F.lit("b"), F.when(F.col("event_id") % 2 == 0, "own"), F.lit("c"), F.when(F.col("event_id") % 3 == 0, "own")), lambda k, v: v.isNotNull()).alias("y"),
    ).select("event_id", security.merged_config("x", "y").alias("merged"))
)
query("filter_internal_topics", "select distinct topic from v_topic where n % 3 <> 1")(
    lambda f: control.visible_topics(f.v_topic.select("topic", F.when(F.col("n") % 3 > 0, F.col("n") % 3 == 1).alias("internal"))).select("topic")
)
query("format_gate", "select broker as path, broker % 4 as version, broker % 4 <= 2 as opens from v_broker")(lambda f: control.format_gate(f.v_broker.select(F.col("broker").alias("path"), (F.col("broker") % 4).alias("version")), 2))
query(
    "role_merge",
    """select node, coalesce(min_by(role, responder) filter (where role <> 'UNKNOWN'), 'UNKNOWN') as role from (
      select distinct event_id % 3 as responder, user_id % 12 as node, case when user_id % 4 = 3 or event_id % 3 = 0 then 'UNKNOWN' when event_id % 3 = 2 then 'LATER'
        when user_id % 2 = 0 then 'LEADER' else 'FOLLOWER' end as role from events) r group by node""",
)(
    lambda f: control.role_merge(
        f.events.select(
            (F.col("event_id") % 3).alias("responder"), (F.col("user_id") % 12).alias("node"),
            F.when((F.col("user_id") % 4 == 3) | (F.col("event_id") % 3 == 0), "UNKNOWN").when(F.col("event_id") % 3 == 2, "LATER").when(F.col("user_id") % 2 == 0, "LEADER").otherwise("FOLLOWER").alias("role"),
        ).distinct()
    )
)
