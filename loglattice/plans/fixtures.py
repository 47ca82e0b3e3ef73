"""Log-shaped frames over the events table; the same SQL runs in Spark and DuckDB, so operators start from equal rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_log": """select cast(user_id % 4 as bigint) as part,
         cast(row_number() over (partition by user_id % 4 order by event_id) - 1 as bigint) as off, ts, event_id,
         case when event_id % 23 = 0 then null else user_id end as k,
         case when event_id % 17 = 0 then null else event_type end as v,
         value as amount, cast(length(props) as bigint) as size_bytes from events""",
    "v_batch": """select part, cast(floor(off / 10.0) as bigint) as batch_no, min(off) as base_off, max(off) as last_off,
         count(*) as n, max(ts) as max_ts, cast(sum(size_bytes) as bigint) as size_bytes,
         cast(floor(off / 10.0) as bigint) % 5 as pid from v_log group by part, cast(floor(off / 10.0) as bigint)""",
    "v_txn": """select part, pid, txn_no, min(base_off) as first_off, max(last_off) as last_off,
         case when txn_no = max(txn_no) over (partition by part, pid) then 'OPEN'
              when txn_no % 3 = 0 then 'ABORT' else 'COMMIT' end as outcome
       from (select *, cast(floor((row_number() over (partition by part, pid order by batch_no) - 1) / 3.0) as bigint) as txn_no
             from v_batch where pid > 0) b group by part, pid, txn_no""",
    "v_tlog": """select part, cast(row_number() over (partition by part order by s, pid) - 1 as bigint) as off,
         is_control, marker, pid, event_id, k, v
       from (select l.part, l.off * 2 as s, false as is_control, cast(null as varchar(9)) as marker, b.pid, l.event_id, l.k, l.v
             from v_log l join v_batch b on l.part = b.part and cast(floor(l.off / 10.0) as bigint) = b.batch_no
             union all
             select part, last_off * 2 + 1, true, outcome, pid, cast(null as bigint), cast(null as bigint), cast(null as varchar(9))
             from v_txn where outcome <> 'OPEN') u""",
    "v_replica": """select l.part, b.broker, b.broker = 1 as is_leader, l.leo - (b.broker - 1) * (l.part + 1) * 7 as leo,
         b.broker <= 2 or l.part % 2 = 0 as in_isr
       from (select part, max(off) + 1 as leo from v_log group by part) l
       cross join (values (cast(1 as bigint)), (cast(2 as bigint)), (cast(3 as bigint))) as b(broker)""",
    "v_epoch": """select part, cast(floor(off / 60.0) as bigint) * 2 as epoch, off + part * 10 as start_off from v_log where off % 60 = 0""",
    "v_commit": """select concat('g', cast(event_id % 3 as varchar(9))) as grp, part, off as log_pos, ts,
         case when event_id % 41 = 0 then null else greatest(off - event_id % 7, 0) end as committed
       from v_log""",
    "v_segment": """select part, cast(floor(off / 500.0) as bigint) * 500 as segment_base, max(off) + 1 as next_off,
         cast(sum(size_bytes) as bigint) as size_bytes, max(ts) as max_ts
       from v_log group by part, cast(floor(off / 500.0) as bigint) * 500""",
    "v_acl": """select * from (values ('alice', 'topic', 'orders', false, 'produce', true), ('alice', 'topic', 'ord', true, '*', true),
         ('alice', 'topic', 'orders', false, 'consume', false), ('bob', 'topic', '*', false, 'consume', true),
         ('carol', 'group', 'g', true, 'consume', true)) as a(principal, rtype, rname, is_prefix, op, allow)""",
    "v_request": """select event_id as id, case event_id % 4 when 0 then 'alice' when 1 then 'bob' when 2 then 'carol' else 'dave' end as principal,
         case when event_id % 5 = 0 then 'group' else 'topic' end as rtype,
         case event_id % 3 when 0 then 'orders' when 1 then 'ordinals' else 'g1' end as rname,
         case when event_id % 2 = 0 then 'produce' else 'consume' end as op from events""",
    "v_meta": """select event_id as off, case event_id % 10 when 0 then 'topic' when 1 then 'partition' when 2 then 'config' when 3 then 'topic'
           when 4 then 'broker' when 5 then 'acl' when 6 then 'remove_acl' when 7 then 'producer_id' when 8 then 'reassignment'
           else case when event_id % 70 = 9 then 'delete_topic' else 'partition' end end as kind,
         concat('t', cast(user_id % 40 as varchar(9))) as name, cast(event_id % 3 as bigint) as item,
         case when event_id % 4 = 2 and event_id % 10 = 8 then null else event_id * 7 % 1000 end as value,
         cast(event_id % 6 as bigint) as leader_epoch, cast(event_id % 4 as bigint) as partition_epoch from events""",
    "v_staged": """select part as coordinator, pid, off as log_pos,
         case when not is_control then 'stage' when marker = 'COMMIT' then 'commit' else 'abort' end as event,
         case when not is_control then concat('c', cast(part as varchar(9)), 'g', cast(event_id % 2 as varchar(9))) end as grp,
         cast(coalesce(event_id, 0) % 5 as bigint) as part, off * 10 as committed, cast(0 as bigint) as epoch
       from v_tlog where pid > 0""",
    "v_masks": """select event_id as member, user_id * 7 % 256 as current_bits, user_id * 37 % 256 as target_bits from events""",
    "v_follow": """select part, broker, is_leader, in_isr, case when part = 1 and broker = 3 then leo + 1000 else leo end as leo,
         case when (part = 0 and broker = 2) or (part = 3 and broker = 2) or (part = 3 and broker = 3) then cast(null as bigint)
              else 100000 - broker * part * 2500 end as last_fetch,
         case when part = 0 then cast(95000 as bigint) when part = 3 then cast(80000 as bigint) else cast(null as bigint) end as first_seen
       from v_replica""",
    "v_subscriber": """select distinct concat('t', cast(event_id % 5 as varchar(9))) as topic, concat('m', cast(user_id % 9 as varchar(9))) as member
       from events where user_id % 9 <= event_id % 5 + 3""",
    "v_topic": """select concat('t', cast(event_id % 5 as varchar(9))) as topic, cast(count(*) % 17 + event_id % 5 as bigint) as n from events group by event_id % 5""",
    "v_broker": """select broker, case broker % 4 when 0 then '' else concat('r', cast(broker % 4 as varchar(9))) end as rack, load,
         cast(row_number() over (order by broker * 5 % 9) as bigint) as seat
       from (select user_id % 9 + 1 as broker, count(*) as load from events group by user_id % 9 + 1) b""",
    "v_txnstate": """select concat('x', cast(part as varchar(9)), '-', cast(pid as varchar(9))) as txn_id, pid, max(txn_no) as epoch,
         case (part + pid) % 4 when 0 then 'ONGOING' when 1 then 'PREPARE_COMMIT' when 2 then 'PREPARE_ABORT' else 'COMPLETE_COMMIT' end as state
       from v_txn group by part, pid""",
    "v_txnpart": """select s.txn_id, 't' as topic, p.part from v_txnstate s join (select distinct part from v_log) p on p.part <= s.pid % 4""",
    "v_session": """select concat('g', cast(user_id % 7 as varchar(9))) as grp, concat('m', cast(user_id % 4 as varchar(9))) as member, event_id,
         case when user_id % 7 = 3 or event_id % 11 = 0 then 'leave' when event_id % 5 = 1 then 'join' else 'heartbeat' end as event from events""",
    "v_member": """select grp, member from (select grp, member, max_by(event, event_id) as last_event from v_session group by grp, member) s
       where last_event <> 'leave'""",
    "v_group": """select grp, cast(sum(case when event <> 'heartbeat' then 1 else 0 end) as bigint) as generation from v_session group by grp""",
    "v_setting": """select event_id, case event_id % 8 when 0 then 'min.insync.replicas' when 1 then 'max.message.bytes' when 2 then 'retention.ms'
           when 3 then 'retention.bytes' when 4 then 'flush.messages' when 5 then 'flush.ms' when 6 then 'segment.bytes' else 'other' end as name,
         case cast(floor(event_id / 8.0) as bigint) % 9 when 0 then 'abc' when 1 then '-1' when 2 then '0' when 3 then ' 5 ' when 4 then '99999999999'
           when 5 then '+7' when 6 then cast(event_id * 100000 as varchar(20)) when 7 then cast(null as varchar(20)) else cast(event_id as varchar(20)) end as raw,
         cast(event_id % 3 + 1 as bigint) as rf from events""",
    "v_request_batch": """select event_id, user_id % 5 as user_no, user_id % 6 as part, length(props) * 100 as size, event_id % 3 - 1 as acks,
         user_id % 6 < 4 and user_id % 11 <> 0 as leads, case when user_id % 6 = 3 then 1 else 2 end as isr,
         event_id % 31 = 0 as corrupt, event_id % 37 = 0 as control from events""",
    "v_sample": """select cast(user_id % 3 + 1 as bigint) as broker, event_id as seq, ts,
         case when event_type in ('click', 'view') then 'FETCH' else 'PRODUCE' end as op,
         cast(floor(value * 1000) as bigint) as latency_us, cast(length(props) as bigint) as bytes from events""",
}


def needed(sql: str) -> list[str]:
    """Views that the SQL uses, directly or not, in the order of their definitions."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\bv_\w+", todo.pop()):
            if name in VIEWS and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in found]


def oracle(sql: str) -> str:
    """The SQL with the views it uses in front."""
    views = [f"{v} as ({VIEWS[v]})" for v in needed(sql)]
    inner = re.sub(r"^\s*with(\s+recursive)?\b", "", sql, flags=re.I)
    if not views:
        return sql
    return ("with recursive " if re.match(r"\s*with\s+recursive", sql, re.I) else "with ") + ",\n".join(views) + (", " if inner != sql else "\n") + inner


class Frames:
    """The views as DataFrames over one data folder, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.cache = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.cache:
            if name in VIEWS:
                used = {v: getattr(self, v) for v in set(re.findall(r"\b(?:v_\w+|events)\b", VIEWS[name])) if v in VIEWS or v == "events"}
                text = re.sub(r"\b(v_\w+|events)\b", lambda m: "{" + m[1] + "}" if m[1] in used else m[1], VIEWS[name])
                self.cache[name] = self.spark.sql(text, **used) if used else self.spark.sql(text)
            else:
                self.cache[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.cache[name]
