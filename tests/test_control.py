"""Coordinators, the metadata log, codecs and tables on small cases."""

from pyspark.sql import functions as F

from loglattice import catalog
from loglattice.functions import binary
from loglattice.operators import control, coordinator, groups, replication, stateful
from loglattice.sources import recordbatch, tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_group_joins_stages_and_evicts():
    group = coordinator.Group(4, 1000)
    assert group.step(0, "join", "a", "ia", 0, ()) == ("ok", "a", 1, 1, [0, 1, 2, 3])
    assert group.step(1, "join", "b", "", 0, ()) == ("ok", "b", 1, 2, [2, 3])
    assert group.step(2, "heartbeat", "a", "", 1, (0, 1, 2, 3)) == ("assignment", "a", 2, 2, [0, 1])
    assert group.step(3, "heartbeat", "a", "", 2, (0, 1)) == ("ok", "a", 2, 2, [0, 1])
    assert group.step(4, "join", "c", "ia", 0, ()) == ("rejoined", "a", 2, 2, [0, 1])
    assert group.step(5, "heartbeat", "a", "", 9, ()) == ("fenced", "a", 2, 2, [0, 1])
    assert group.step(6, "heartbeat", "x", "", 0, ()) == ("unknown_member", "x", 0, 2, [])
    assert group.step(1002, "heartbeat", "a", "", 2, (0, 1)) == ("assignment", "a", 3, 3, [0, 1, 2, 3])
    assert group.step(1003, "leave", "a", "", 3, ()) == ("left", "a", 0, 4, [])
    assert group.step(1004, "join", "c", "ia", 0, ()) == ("ok", "c", 1, 5, [0, 1, 2, 3])


def test_a_share_moves_in_two_steps():
    group = coordinator.Group(6, 10**9)
    group.step(0, "join", "b", "", 0, ())
    group.step(1, "join", "c", "", 0, ())
    assert group.step(2, "heartbeat", "b", "", 2, (0, 1, 2))[4] == [0, 1, 2]
    group.step(3, "join", "a", "", 0, ())
    assert group.step(4, "heartbeat", "b", "", 2, (0, 1, 2)) == ("assignment", "b", 3, 3, [2])
    assert group.step(5, "heartbeat", "b", "", 3, (2,)) == ("assignment", "b", 4, 3, [2, 3])


def test_staged_offsets_follow_epochs(spark):
    steps = [(0, "stage", "g", 0, 5, 1), (1, "stage", "g", 1, 6, 1), (2, "stage", "g", 0, 4, 0), (3, "commit", None, None, None, 0), (4, "commit", None, None, None, 1), (5, "stage", "g", 0, 9, 0), (6, "stage", "g", 0, 8, 2), (7, "stage", "g", 1, 7, 3), (8, "commit", None, None, None, 3), (9, "stage", "g", 0, 1, 3), (10, "abort", None, None, None, 3)]
    assert list(coordinator.staging_steps(steps)) == [("g", 0, 5, 4), ("g", 1, 6, 4), ("g", 1, 7, 8)]
    table = spark.createDataFrame([(0, 1, *s) for s in steps] + [(0, 2, 20, "stage", "g", 0, 33, 0), (0, 2, 21, "commit", None, None, None, 0)], "coordinator long, pid long, log_pos long, event string, grp string, part long, committed long, epoch long")
    assert rows(coordinator.committed_offsets_txn(table), "grp", "part", "committed") == [("g", 0, 33), ("g", 1, 7)]
    assert rows(coordinator.committed_offsets_txn(table.limit(0)), "grp") == []


def test_folds_of_markers_grants_and_raw_appends():
    events = [("data", 1, 0, 0, 0), ("commit", 1, 0, 5, 1), ("commit", 1, 0, 5, 2), ("commit", 1, 0, 4, 3), ("data", 2, 0, 0, 4), ("commit", 1, 0, 5, 5)]
    assert list(coordinator.marker_steps(events)) == [(0, "appended", 0), (1, "appended", 1), (2, "repeated", 1), (3, "refused", -1), (4, "appended", 2), (5, "appended", 3)]
    assert list(coordinator.grant_steps([(0, 5), (500, 3), (500, 9), (9000, 99)], 10.0, 10.0)) == [0, 3, 2, 10]
    assert list(coordinator.grant_steps([(0, 5)], 0, 0)) == [5]
    assert list(coordinator.raw_append_steps([(0, 4), (3, 9), (7, 8), (8, 9), (9, 9)])) == ["append", "rejected", "append", "rejected", "append"]
    assert stateful.greedy_moves([(0, 1), (0, 2)], {1: 1, 2: 1, 3: 0, 4: 5}, 1, {1: "a", 2: "b", 3: "b", 4: "c"}) == {0: 4}


def test_deal_skips_members_that_do_not_subscribe():
    subscribed = {"m1": {"a"}, "m2": {"a", "b"}, "m3": {"b"}}
    assert coordinator.deal_steps([("a", 0), ("b", 0), ("b", 1), ("b", 2), ("a", 1), ("c", 0)], subscribed) == [("a", 0, "m1"), ("b", 0, "m2"), ("b", 1, "m3"), ("b", 2, "m2"), ("a", 1, "m1")]
    assert coordinator.deal_steps([("a", 0)], {}) == []


def test_epoch_requests_and_commit_index(spark):
    epochs = spark.createDataFrame([(0, 1, 0), (0, 4, 50)], "part long, epoch long, start_off long")
    ends = spark.createDataFrame([(0, 80), (1, 9)], "part long, leo long")
    asked = spark.createDataFrame([(0, 0), (0, 1), (0, 3), (0, 4), (0, 9), (1, 0)], "part long, req long")
    assert rows(replication.offsets_for_leader_epoch(epochs, ends, asked), "part", "req", "end_offset") == [(0, 0, -1), (0, 1, 50), (0, 3, 50), (0, 4, 80), (0, 9, 80), (1, 0, -1)]
    matches = spark.createDataFrame([(0, 1, 10), (0, 2, 7), (0, 3, 3), (1, 1, 5)], "part long, broker long, match_index long")
    starts = spark.createDataFrame([(0, 8), (1, 5)], "part long, start_off long")
    assert rows(replication.raft_commit_index(matches), "part", "commit_index") == [(0, 7), (1, 5)]
    assert rows(replication.raft_commit_index(matches, starts), "part", "commit_index") == [(0, -1), (1, 5)]


def test_record_batches_through_frames(spark):
    log = spark.createDataFrame([(p, o, o, b"k", None if o % 3 else b"v") for p in range(2) for o in range(7)], "part long, off long, ts_ms long, key binary, value binary")
    batches = recordbatch.encoded(log, 3)
    assert rows(batches, "part", "base_off") == [(p, b) for p in range(2) for b in (0, 3, 6)]
    assert rows(recordbatch.decoded(batches), *log.columns) == rows(log, *log.columns)


def test_decommission_refuses_whole(spark):
    replicas = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 3), (2, 2)], "part long, broker long")
    brokers = spark.createDataFrame([(1, None), (2, None), (3, None)], "broker long, rack string")
    assert rows(control.plan_decommission(replicas, brokers, 1), "part", "replacement", "refused") == [(0, 3, False), (1, 2, False)]
    assert rows(control.plan_decommission(replicas, brokers.where("broker < 3"), 1), "part", "replacement", "refused") == [(0, None, True), (1, 2, True)]


def test_metadata_log(spark):
    log = [(0, "topic", "t", 1, 0, 0), (1, "partition", "t", 2, 1, 1), (2, "delete_topic", "t", None, 0, 0), (3, "config", "t", 9, 0, 0), (4, "partition", "t", 5, 0, 2), (5, "partition", "t", 6, 0, 2), (6, "topic", "u", 3, 0, 0), (7, "config", "u", 4, 0, 0)]
    log += [(8, "acl", "a", 1, 0, 0), (9, "remove_acl", "a", None, 0, 0), (10, "reassignment", "u", 1, 0, 0), (11, "reassignment", "u", None, 0, 0), (12, "producer_id", None, 50, 0, 0), (13, "producer_id", None, 40, 0, 0)]
    table = spark.createDataFrame([(o, k, n, 0, v, le, pe) for o, k, n, v, le, pe in log], "off long, kind string, name string, item long, value long, leader_epoch long, partition_epoch long")
    assert rows(control.meta_fold(table), "entity", "name", "item", "value") == [("partition", "t", 0, 5), ("producer_id", None, None, 50), ("topic", "u", None, 4)]


def test_cluster_views(spark):
    parts = spark.createDataFrame([(0, [3, 1], 4), (1, [2], 0), (2, [], 0)], "part long, isr array<long>, epoch long")
    assert rows(control.recover_offline(parts, spark.createDataFrame([(1,), (3,)], "broker long")), "part", "leader", "epoch") == [(0, 3, 5)]
    members = spark.createDataFrame([("a", [1, 2], [2, 3], 1), ("b", [1], [1, 2], 1), ("c", [1, 2], [1], 1), ("d", [1], [1], 1)], "member string, current array<int>, target array<int>, epoch int")
    assert rows(control.stage_cooperative(members), "member", "held", "pending", "epoch") == [("a", [2], [2, 3], 2), ("b", [1, 2], None, 2), ("c", [1], None, 2), ("d", [1], None, 1)]
    log = spark.createDataFrame([(0, i) for i in range(5)], "part long, off long")
    assert rows(groups.group_poll(log, spark.createDataFrame([("m", 0)], "member string, part long"), spark.createDataFrame([], "part long, off long"), 2), "member", "off") == [("m", 0), ("m", 1)]


def test_codecs_round_trip(spark):
    table = spark.createDataFrame([("grüße", "t", -1, (1 << 62) + 7, -2, None, -5), ("", "", 7, 0, 0, "x" * 300, 1 << 40)], "g string, t string, p long, o long, e long, m string, at long")
    coded = table.select("*", binary.offset_key(*map(F.col, "gtp")).alias("k"), binary.offset_value(F.col("o"), F.col("e"), F.col("m"), F.col("at")).alias("v"))
    read = coded.select("g", "t", "p", "o", "e", "m", "at", binary.read_offset_key(F.col("k")).alias("rk"), binary.read_offset_value(F.col("v")).alias("rv"))
    for r in read.collect():
        assert tuple(r["rk"]) == (r["g"], r["t"], r["p"]) and tuple(r["rv"]) == (r["o"], r["e"], r["m"] or "", r["at"])
    for cut in (0, 1, 2, 5):
        short = coded.where("p = 7").select(binary.read_offset_key(F.substring("k", 1, cut)).alias("k"), binary.read_offset_value(F.substring("v", 1, 14 + cut)).alias("v")).first()
        assert short["k"] is None and short["v"] is None
    numbers = spark.createDataFrame([(n,) for n in (0, -1, 1, 63, -64, 64, -65, 1 << 40, -(1 << 63))], "n long")
    assert all(r["s"] == len(binary.zigzag(r["n"])) for r in numbers.select("n", binary.varint_size(F.col("n")).alias("s")).collect())


def integers_read(spark, tmp_path, name):
    """How often the plan of a query reads an integer from bytes."""
    spark.range(100).selectExpr("id as event_id", "id % 8 as user_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "'view' as event_type", "1.0d as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    return catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("conv(")


def test_offsets_are_read_once(spark, tmp_path):
    assert 0 < integers_read(spark, tmp_path, "codec_offsets_topic_read") <= 8
    coded = spark.range(1).select(binary.offset_key(F.lit("gé"), F.lit("topic"), F.lit(-7)).alias("k"), binary.offset_value(F.lit(-1), F.lit(2), F.lit("meta"), F.lit(-9)).alias("v"))
    cut = coded.select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("n"))
    for r in cut.select("k", "v", "n", binary.read_offset_key(F.substring("k", F.lit(1), F.col("n"))).alias("rk"), binary.read_offset_value(F.substring("v", F.lit(1), F.col("n"))).alias("rv")).collect():
        assert r["rk"] == (("gé", "topic", -7) if r["n"] >= len(r["k"]) else None) and r["rv"] == ((-1, 2, "meta", -9) if r["n"] >= len(r["v"]) else None)
    assert tuple(coded.select(binary.read_offset_key(F.lit(None).cast("binary")), binary.read_offset_value(F.lit(None).cast("binary"))).first()) == (None, None)


def test_transaction_values_round_trip(spark):
    table = spark.createDataFrame([(1, [("t", 3), ("grüße", -1), ("", 0)]), (2, [])], "pid long, parts array<struct<topic:string,part:bigint>>")
    coded = table.select("pid", "parts", binary.transaction_value(F.col("pid"), F.lit(-3), F.lit(2), F.lit(60000), F.lit(-9), F.col("parts")).alias("v"))
    for r in coded.select("pid", "parts", binary.read_transaction_head(F.col("v")).alias("h"), binary.read_transaction_partitions(F.col("v")).alias("p")).collect():
        assert tuple(r["h"]) == (r["pid"], -3, 2, 60000, -9, len(r["parts"])) and r["p"] == r["parts"]
    short = coded.where("pid = 1").select(binary.read_transaction_partitions(F.substring("v", 1, 33)).alias("a"), binary.read_transaction_partitions(F.substring("v", 1, 49)).alias("b"), binary.read_transaction_head(F.substring("v", 1, 20)).alias("c")).first()
    assert tuple(short) == (None, None, None)


def test_transaction_heads_are_read_once(spark, tmp_path):
    assert 0 < integers_read(spark, tmp_path, "codec_txn_topic_read") <= 6
    parts = F.array(F.struct(F.lit("t").alias("topic"), F.lit(1).alias("part")))
    coded = spark.range(31).select("id", binary.transaction_value(F.lit(-1), F.lit(2), F.lit(-3), F.lit(4), F.lit(-5), parts).alias("v"))
    for r in coded.select("id", binary.read_transaction_head(F.substring("v", F.lit(1), F.col("id").cast("int"))).alias("h")).collect():
        assert r["h"] == ((-1, 2, -3, 4, -5, 1) if r["id"] >= 29 else None)
    assert coded.select(binary.read_transaction_head(F.lit(None).cast("binary")).alias("h")).first()["h"] is None


def test_tables(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "part long, v string")
    tables.append(spark, path, first, "v")
    tables.append(spark, path, spark.createDataFrame([(0, "d"), (2, "e")], "part long, v string"), "v", epoch=1)
    assert rows(spark.read.parquet(path), "part", "off", "v", "leader_epoch") == [(0, 0, "a", 0), (0, 1, "b", 0), (0, 2, "d", 1), (1, 0, "c", 0), (2, 0, "e", 1)]
    tables.snapshot(str(tmp_path / "meta"), 1, {"topics": first})
    tables.snapshot(str(tmp_path / "meta"), 2, {"topics": first.limit(0), "acls": first})
    assert {n: f.count() for n, f in tables.restore(spark, str(tmp_path / "meta")).items()} == {"topics": 0, "acls": 3}
    assert tables.restore(spark, str(tmp_path / "meta"), 1)["topics"].count() == 3 and tables.restore(spark, str(tmp_path / "meta"), 0) == {}
    handled, dead = tables.dead_letters(first, F.when(F.col("v") == "b", "bad"), 3)
    assert rows(handled, "v") == [("a",), ("c",)] and [r["headers"] for r in dead.collect()] == [{"cause": "bad", "tries": "3"}]
