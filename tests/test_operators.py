"""Small cases of the log operators, and the folds and codec against plain Python."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loglattice import catalog
from loglattice.functions.binary import crc32c, unzigzag, zigzag
from loglattice.operators import groups, log, replication, security, stateful, txn
from loglattice.sources import recordbatch


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_compaction(spark):
    table = spark.createDataFrame([(0, 0, "a", "1"), (0, 1, "b", "1"), (0, 2, "a", "2"), (0, 3, None, "x"), (0, 4, "b", None), (0, 5, None, "y"), (1, 0, "a", "z")], "part long, off long, k string, v string")
    assert rows(log.compact_latest_by_key(table), "part", "off") == [(0, 2), (0, 3), (0, 5), (1, 0)]


def test_range_assignment(spark):
    members = spark.createDataFrame([("t", f"m{i}") for i in range(4)] + [("u", "m0"), ("u", "m1")], "topic string, member string")
    parts = spark.createDataFrame([("t", 9), ("u", 1)], "topic string, n long")
    got = groups.assign_range(members, parts)
    assert {m: n for m, n in rows(got.where("topic = 't'").groupBy("member").count(), "member", "count")} == {"m0": 3, "m1": 2, "m2": 2, "m3": 2}
    assert rows(got.where("topic = 'u'"), "member", "part") == [("m0", 0)]


def test_read_committed(spark):
    table = spark.createDataFrame(
        [(0, 0, 1, False, None), (0, 1, 0, False, None), (0, 2, 2, False, None), (0, 3, 1, True, "ABORT"), (0, 4, 1, False, None), (0, 5, 1, True, "COMMIT"), (0, 6, 2, True, "COMMIT"), (0, 7, 3, False, None), (0, 8, 0, False, None)],
        "part long, off long, pid long, is_control boolean, marker string",
    )
    assert rows(txn.last_stable_offset(table), "lso") == [(7,)]
    assert rows(txn.filter_read_committed(table), "off") == [(1,), (2,), (4,)]
    assert rows(txn.aborted_txn_index(table), "pid", "first_off", "last_off") == [(1, 0, 3)]


def test_leader_choice(spark):
    table = spark.createDataFrame([(0, 1, [1, 2], [1, 2, 3], 5), (1, 1, [1], [1, 2], 0), (2, 3, [3, 2], [2, 3], 1)], "part long, leader long, isr array<long>, replicas array<long>, epoch long")
    assert rows(replication.pick_new_leader(table, 1), "part", "leader", "epoch") == [(0, 2, 6), (1, -1, 1), (2, 3, 1)]
    assert rows(replication.preferred_leader(table), "part", "leader", "epoch") == [(2, 2, 2)]


def test_acl(spark):
    acls = spark.createDataFrame([("a", "topic", "ord", True, "*", True), ("a", "topic", "orders", False, "read", False)], "principal string, rtype string, rname string, is_prefix boolean, op string, allow boolean")
    asked = spark.createDataFrame([(1, "a", "topic", "orders", "read"), (2, "a", "topic", "ordinal", "read"), (3, "a", "topic", "x", "read")], "id long, principal string, rtype string, rname string, op string")
    decided = security.acl_allows(acls, asked)
    assert sorted((r["id"], r["allowed"]) for r in decided.collect()) == [(1, False), (2, True), (3, None)]
    assert rows(security.acl_authorize(decided, []), "id", "authorized") == [(1, False), (2, True), (3, False)]


def test_folds():
    assert list(stateful.dedup_steps([(5, 2), (7, 1), (7, 1), (9, 1), (8, 1)])) == ["append", "append", "cached", "out_of_order", "append"]
    assert list(stateful.seal_steps([(0, 5), (1, 6), (2, 1), (60, 1)], 10, 50)) == [0, 0, 1, 2]
    assert list(stateful.roll_steps([5, 6, 1], 10)) == [0, 0, 1]
    assert list(stateful.bucket_steps([(0, 10), (0, 1), (100, 1)], 10.0)) == [0, 100, 0]
    assert [o for _, o in stateful.txn_steps([("add", 0), ("commit", 0), ("commit", 0), ("abort", 0), ("markers", 0), ("add", 1), ("add", 0)])] == ["ok", "ok", "retry", "invalid", "ok", "ok", "fenced"]
    assert list(stateful.cas_steps([(0, 1, 0), (0, 2, 0), (1, 2, 0)])) == [True, False, True]
    assert stateful.greedy_moves([(0, 1), (0, 2), (1, 1), (1, 3)], {1: 2, 2: 1, 3: 1, 4: 0}, 1) == {0: 4, 1: 2}


@given(st.integers(-(1 << 63), (1 << 63) - 1))
def test_zigzag(value):
    assert unzigzag(zigzag(value), 0) == (value, len(zigzag(value)))


def test_crc32c_known_vector():
    assert crc32c(b"123456789") == 0xE3069283


maybe = st.none() | st.binary(max_size=12)


@given(st.lists(st.tuples(st.integers(0, 1 << 40), maybe, maybe, st.lists(st.tuples(st.binary(max_size=3), maybe), max_size=2)), max_size=8), st.booleans())
def test_batches_round_trip(records, packed):
    data = recordbatch.encode(7, records, producer=(3, 1, 0), zstd=packed)
    found, end = recordbatch.decode(data)
    assert end == len(data) and [(r["ts_ms"], r["key"], r["value"], [(h["key"], h["value"]) for h in r["headers"]]) for r in found] == records
    assert [r["off"] for r in found] == list(range(7, 7 + len(records)))
    assert recordbatch.decode(data[:-1]) is None
    with pytest.raises(ValueError, match="checksum"):
        recordbatch.decode(data[:30] + bytes([data[30] ^ 1]) + data[31:])


def test_segment_reader(spark, tmp_path):
    one, two = recordbatch.encode(0, [(1, b"k", b"v", [])] * 3), recordbatch.encode(3, [(2, None, None, [(b"h", b"x")])])
    (tmp_path / "00.log").write_bytes(one + two + two[:20])
    assert [r["off"] for r in recordbatch.read_segments(spark, str(tmp_path)).orderBy("off").collect()] == [0, 1, 2, 3]


def test_streams(spark, tmp_path):
    from loglattice.streaming.jobs import dedup_stream, exactly_once_sink

    kind = "part long, pid long, seq long, n long"
    spark.createDataFrame([(0, 1, 0, 2), (0, 1, 2, 1), (0, 1, 5, 1)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    job = dedup_stream(stream).writeStream.outputMode("append").format("memory").queryName("verdicts").trigger(availableNow=True).start()
    job.awaitTermination()
    assert rows(spark.table("verdicts"), "seq", "verdict") == [(0, "append"), (2, "append"), (5, "out_of_order")]
    exactly_once_sink(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    exactly_once_sink(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_absolute_offsets_of_every_record(spark, tmp_path):
    events = [(i, i % 8) for i in range(1, 101)]  # 25 records a partition, so batches of 10, 10 and 5
    frame = spark.createDataFrame(events, "event_id long, user_id long").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts", "'view' as event_type", "1.0d as value", "'{}' as props")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["project_absolute_offset"](spark, str(tmp_path))
    assert rows(got, "part", "off") == [(p, off) for p in range(4) for off in range(25)]


def test_source_events_gives_all_behind_the_position(spark, tmp_path):
    spark.range(1, 4001).selectExpr("id as event_id", "'view' as event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["source_events"](spark, str(tmp_path))
    assert rows(got, "event_id") == [(i,) for i in range(501, 4001)]


def test_ledger_missing_takes_all_events_as_acked(spark, tmp_path):
    spark.range(1, 101).selectExpr("id as event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(catalog.queries()["ledger_missing"](spark, str(tmp_path)), "event_id") == [(i,) for i in range(1, 101) if i % 3]
