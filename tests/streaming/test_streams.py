import time

import pytest
from pyspark.sql import functions as F

from loomlog.functions import json_schema
from loomlog.operators import groups, produce
from loomlog.sources import log_source
from loomlog.streaming import groups as group_stream
from loomlog.streaming import loops, tables
from loomlog.streaming import produce as stream

RECORDS = "topic string, partition int, batch long, seq long, value string"


def rows(first, last):
    bad = {3, 10, 11, 12}
    return [("t", i % 2, i // 3, i, "x" if i in bad else '{"k": %d}' % i) for i in range(first, last)]


def test_stream_equals_batch(spark, tmp_path):
    json_schema.allow_duplicate_keys(spark)
    schemas = spark.createDataFrame([("t", {"k": "integer"})], "topic string, schema map<string,string>")
    src, log, dlq, ck = (str(tmp_path / x) for x in ("src", "log", "dlq", "ck"))
    for part in (rows(0, 9), rows(9, 30)):
        spark.createDataFrame(part, RECORDS).coalesce(1).write.mode("append").parquet(src)
        stream.start(spark.readStream.schema(RECORDS).parquet(src), log, dlq, ck, schemas).awaitTermination()
    routed = produce.route(produce.validate(spark.createDataFrame(rows(0, 30), RECORDS), schemas))
    want = routed.filter("to_log")
    got = spark.read.parquet(log)
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect())
    for p in (0, 1):
        mine = got.filter(F.col("partition") == p).orderBy("offset").collect()
        assert [r.offset for r in mine] == list(range(len(mine))) and [r.seq for r in mine] == sorted(r.seq for r in mine)
    assert sorted(r.seq for r in spark.read.parquet(dlq).filter("topic = 't.dlq'").collect()) == sorted(r.seq for r in routed.filter("to_dlq").collect())


def test_repeated_epoch_writes_nothing_twice(spark, tmp_path):
    schemas = spark.createDataFrame([], "topic string, schema map<string,string>")
    run = stream.pipeline(str(tmp_path / "log"), str(tmp_path / "dlq"), schemas)
    for epoch, part in ((0, rows(0, 6)), (1, rows(6, 12)), (1, rows(6, 12))):
        run(spark.createDataFrame(part, RECORDS), epoch)
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted(r.seq for r in got) == list(range(12)) and sorted(r.offset for r in got if r.partition == 0) == list(range(6))


def test_ends_are_kept_beside_the_log(spark, tmp_path):
    schemas = spark.createDataFrame([], stream.SCHEMAS)
    log = str(tmp_path / "log")
    run = stream.pipeline(log, str(tmp_path / "dlq"), schemas)
    for epoch, part in ((0, rows(0, 6)), (1, rows(6, 12)), (4, rows(12, 15))):
        run(spark.createDataFrame(part, RECORDS), epoch)
    assert {(r.partition, r.start) for r in stream.next_offsets(spark, log, 4).collect()} == {(0, 6), (1, 6)}
    assert {(r.partition, r.start) for r in stream.next_offsets(spark, log, 9).collect()} == {(0, 8), (1, 7)}
    assert spark.read.parquet(log).count() == 15


def test_first_value_sets_the_schema_once(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("log", "dlq", "registry")]
    run = stream.pipeline(paths[0], paths[1], spark.createDataFrame([], stream.SCHEMAS), registry_path=paths[2])
    one = lambda i, v: ("t", 0, i, i, v)
    parts = [[one(0, '{"k": 1}'), one(1, '{"k": "free"}')], [one(2, '{"k": 2}'), one(3, '{"k": "x"}')], [one(4, '{"other": 1}')]]
    for epoch in (0, 1, 1, 2):
        run(spark.createDataFrame(parts[epoch], RECORDS), epoch)
    assert sorted(r.seq for r in spark.read.parquet(paths[0]).collect()) == [0, 1, 2]
    assert sorted(r.seq for r in spark.read.parquet(paths[1]).collect()) == [3, 4]
    assert [(r.topic, r.schema) for r in tables.before(spark, paths[2], None, stream.SCHEMAS).collect()] == [("t", {"k": "integer"})]


def test_follower_copies_what_is_new(spark, tmp_path):
    spark.dataSource.register(log_source.LogDataSource)
    leader, replica, ck = (str(tmp_path / x) for x in ("leader", "replica", "ck"))
    append = lambda *v: spark.createDataFrame([("t", 0, i, 0, 7, None, x) for i, x in enumerate(v)], log_source.SCHEMA).coalesce(1).write.format("log").option("path", leader).mode("append").save()
    for values in ((b"a", b"b"), (b"c",)):
        append(*values)
        loops.follow(spark, leader, replica, ck).awaitTermination()
    read = lambda root: sorted((r.batch_offset, bytes(r.value)) for r in spark.read.format("log").option("path", root).load().collect())
    assert read(replica) == read(leader) == [(0, b"a"), (1, b"b"), (2, b"c")]
    again = spark.read.format("log").option("path", leader).load().coalesce(1)
    again.write.format("log").option("path", replica).option("keepOffsets", "true").mode("append").save()
    assert read(replica) == read(leader)
    with pytest.raises(Exception, match="would leave a gap"):
        again.filter("batch_offset = 2").withColumn("batch_offset", F.lit(9).cast("long")).write.format("log").option("path", replica).option("keepOffsets", "true").mode("append").save()


def partitions(spark):
    return spark.createDataFrame([("t", p, 1, [1, 2, 3], [1, 2, 3], 0, 0, 0) for p in (0, 1)], loops.PARTITIONS)


def test_in_sync_loop_follows_the_fetches(spark, tmp_path):
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    schema = "topic string, partition int, broker_id int, delivered long, error int, seq long, ts_ms long"
    parts = [([(b, 10, 1000) for b in (1, 2, 3)], 2000), ([(1, 30, 20_000), (2, 25, 20_000)], 20_000), ([(3, 30, 21_000)], 21_000)]
    want = [([1, 2, 3], 10, 0), ([1, 2], 25, 1), ([1, 2, 3], 25, 2)]
    for k, (part, now) in enumerate(parts):
        rows_ = [("t", p, b, leo, 0, k * 10 + b, ts) for p in (0, 1) for b, leo, ts in part]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
        loops.maintain(spark.readStream.schema(schema).parquet(src), partitions(spark), state, ck, lambda now=now: now).awaitTermination()
        found = tables.before(spark, f"{state}/partitions", None, loops.PARTITIONS).collect()
        assert [(r.isr, r.hw, r.partition_epoch) for r in found] == [want[k]] * 2


def test_health_loop_fails_over_once(spark, tmp_path):
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    schema = "broker_id int, seq long, reachable boolean"
    parts = [[(1, 1, True), (1, 2, False), (2, 1, True)], [(1, 3, False)], [(1, 4, False), (2, 2, False)], [(1, 5, False)], [(1, 6, True)], [(2, 3, False), (2, 4, False)]]
    want = [(1, [1, 2, 3]), (1, [1, 2, 3]), (2, [2, 3]), (2, [2, 3]), (2, [2, 3]), (3, [3])]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        loops.control(spark.readStream.schema(schema).parquet(src), partitions(spark), state, ck).awaitTermination()
        found = tables.before(spark, f"{state}/partitions", None, loops.PARTITIONS).collect()
        assert [(r.leader_id, r.isr) for r in found] == [want[k]] * 2, k
    brokers = {r.broker_id: (r.failures, r.alive) for r in tables.before(spark, f"{state}/brokers", None, loops.BROKERS).collect()}
    assert brokers == {1: (0, True), 2: (3, False)} and {r.leader_epoch for r in found} == {2}


def test_waiting_for_the_watermark(spark):
    now, marks = [0.0], [3, 3, 8]
    wanted = spark.createDataFrame([("t", 0, 5), ("u", 0, 0)], "topic string, partition int, offset long")
    read = lambda: spark.createDataFrame([("t", 0, marks.pop(0) if len(marks) > 1 else marks[0])], "topic string, partition int, hw long")
    sleep = lambda s: now.__setitem__(0, now[0] + s)
    out = loops.wait_for_watermark(read, wanted, 40, 5, lambda: now[0], sleep).collect()
    assert {(r.topic, r.reached) for r in out} == {("t", True), ("u", False)} and now[0] == pytest.approx(0.04)


def test_group_stream_equals_the_machine(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep the query running
    now = int(time.time() * 1000)
    e = lambda seq, member, event, generation=0, payload=None: (seq, now + seq, "g", member, event, generation, 2 * 10**9, ["r"], payload)
    parts = [[e(1, "a", "join"), e(2, "a", "sync", 1, '{"a": "A"}')], [e(3, "a", "heartbeat", 1), e(4, "b", "heartbeat", 1), e(5, "a", "leave")]]
    src = str(tmp_path / "src")
    for part in parts:
        spark.createDataFrame(part, groups.EVENTS).coalesce(1).write.mode("append").parquet(src)
        out = group_stream.group_results(spark.readStream.schema(groups.EVENTS).parquet(src), delay_ms=0)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = groups.replay(spark.createDataFrame([x for p in parts for x in p], groups.EVENTS), delay_ms=0)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out")).select(*want.columns)) == key(want)
