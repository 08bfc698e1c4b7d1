import random

import pytest
from pyspark.sql import functions as F

from loomlog.functions import errors
from loomlog.operators import catalog, fetch, logview, offsets, produce, replication, storage


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_offsets_are_dense_whatever_the_ranges(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 1000) for i in range(1000)], "p int, n long").repartition(6)
    want = rows(logview.assign_offsets(df, ["p"], "n", 1))
    for buckets in (2, 7, 64):
        assert rows(logview.assign_offsets(df, ["p"], "n", buckets).select("p", "n", "offset")) == want
    assert logview.assign_offsets(df.limit(0), ["p"], "n").columns == ["p", "n", "offset"]


@pytest.mark.parametrize("buckets", [None, 2, 9])
def test_offsets_keep_rows_without_order_or_key(spark, buckets):
    df = spark.createDataFrame([("a", 3), ("a", None), (None, 1), ("a", 10**12), (None, None), ("a", 2), (None, 7)], "k string, n long")
    assert rows(logview.assign_offsets(df, ["k"], "n", buckets), "k", "n", "offset") == sorted(
        [("a", 2, 0), ("a", 3, 1), ("a", 10**12, 2), ("a", None, 3), (None, 1, 0), (None, 7, 1), (None, None, 2)], key=str
    )


def test_one_outlier_does_not_fill_a_range(spark):
    df = spark.createDataFrame([(i,) for i in range(4000)] + [(10**15,)], "n long").withColumn("p", F.lit(0))
    plan = logview.assign_offsets(df, ["p"], "n", 8)
    assert rows(plan, "n", "offset") == sorted([(i, i) for i in range(4000)] + [(10**15, 4000)], key=str)


def test_replay_takes_the_last_write(spark):
    commits = spark.createDataFrame([("g", "t", 0, 1, 100), ("g", "t", 0, 2, 42), ("g", "u", 0, 3, 7)], "group string, topic string, partition int, seq long, offset long")
    assert rows(offsets.replay(commits)) == [("g", "t", 0, 42), ("g", "u", 0, 7)]


@pytest.mark.parametrize(
    ("epoch", "replica", "error"), [(1, False, 74), (3, False, 6), (2, False, 0), (-1, False, 0), (3, True, 0), (1, True, 74)]
)
def test_fencing(spark, epoch, replica, error):
    assert spark.range(1).select(fetch.fence(F.lit(epoch), F.lit(2), F.lit(replica))).first()[0] == error


def test_unknown_topic_id_is_its_own_error(spark):
    topics = spark.createDataFrame([("a", "id-a")], "name string, topic_id string")
    requests = spark.createDataFrame(
        [(0, 0, "", "id-a", 0), (0, 1, "", "id-x", 0), (0, 2, "a", None, 9), (0, 3, "b", None, 0)], "topic_pos int, part_pos int, topic string, topic_id string, partition int"
    ).withColumns({"fetch_offset": F.lit(0), "epoch": F.lit(-1), "replica_id": F.lit(-1)})
    parts = spark.createDataFrame([("a", 0, 0, 5, 7)], "topic string, partition int, leader_epoch int, hw long, leo long")
    assert rows(fetch.plan(fetch.resolve_topics(requests, topics), parts), "part_pos", "error") == [(0, 0), (1, 100), (2, 3), (3, 100)]


def test_budget_cuts_the_crossing_record_and_ranges_do_not_matter(spark):
    records = spark.createDataFrame([(0, p, p, o, 10) for p in (0, 1) for o in range(20)], "topic_pos int, part_pos int, partition int, offset long, bytes long")
    for size in (1, 3, 1000):
        got = fetch.within_budget(records, 215, size)
        assert got.count() == 22 and got.agg(F.sum("returned_bytes")).first()[0] == 215
    assert fetch.within_budget(records, 0).count() == 40
    assert fetch.ready(records, 400, 0, 9) and not fetch.ready(records, 401, 0, 9) and fetch.ready(records.limit(0), 1, 9, 9)


def test_answers_carry_their_records_and_polls_wait(spark):
    topics = spark.createDataFrame([("a", "id-a")], "name string, topic_id string")
    parts = spark.createDataFrame([("a", 0, 0, 3, 3)], "topic string, partition int, leader_epoch int, hw long, leo long")
    log = spark.createDataFrame([("a", 0, o, f"k{o}", f"v{o}", 10) for o in range(3)], "topic string, partition int, offset long, key string, value string, bytes long")
    requests = spark.createDataFrame([(0, 0, "a", None, 0, 1, -1, -1), (0, 1, "a", None, 7, 0, -1, -1)], "topic_pos int, part_pos int, topic string, topic_id string, partition int, fetch_offset long, epoch int, replica_id int")
    answer = fetch.with_records(*fetch.fetch(requests, topics, parts, log, 15)).orderBy("part_pos").collect()
    assert [[(x.offset, x.value, x.returned_bytes) for x in r.records or []] for r in answer] == [[(1, "v1", 10), (2, "v2", 5)], []]
    now, tries = [0.0], []
    attempt = lambda: tries.append(1) or fetch.fetch(requests, topics, parts, log.filter(F.col("offset") < len(tries)), 0)
    sleep = lambda s: now.__setitem__(0, now[0] + s)
    assert fetch.poll(attempt, 20, 1000, 5, lambda: now[0], sleep)[1].count() == 2 and len(tries) == 3
    assert fetch.poll(attempt, 10**6, 12, 5, lambda: now[0], sleep)[1].count() == 2 and len(tries) in (7, 8)


def state(spark, *replicas):
    return spark.createDataFrame([("t", 0, b, leo, seen) for b, leo, seen in replicas], "topic string, partition int, broker_id int, leo long, last_seen_ms long")


def partition(spark, leader=1, isr=(1, 2, 3), replicas=(1, 2, 3), hw=0):
    row = ("t", 0, leader, list(replicas), list(isr), 0, 0, hw)
    return spark.createDataFrame([row], "topic string, partition int, leader_id int, replicas array<int>, isr array<int>, leader_epoch int, partition_epoch int, hw long")


def test_high_watermark_is_monotonic_and_counts_missing_as_zero(spark):
    ends = state(spark, (1, 9, 0), (2, 5, 0))
    assert rows(replication.high_watermark(partition(spark, isr=(1, 2)), ends), "hw") == [(5,)]
    assert rows(replication.high_watermark(partition(spark), ends), "hw") == [(0,)]
    assert rows(replication.high_watermark(partition(spark, hw=7, isr=(1, 2)), ends), "hw") == [(7,)]
    assert rows(replication.high_watermark(partition(spark, hw=7, isr=()), ends), "hw") == [(7,)]


@pytest.mark.parametrize(
    ("replicas", "isr"),
    [
        (((1, 10, 100_000), (2, 10, 100_000), (3, 10, 80_000)), [1, 2]), (((1, 20_000, 100_000), (2, 20_000, 100_000), (3, 5000, 100_000)), [1, 2]),
        (((1, 5, 100_000), (2, 5, 100_000)), [1, 2]), (((2, 5, 100_000),), [1, 2]),
    ],
)
def test_in_sync(spark, replicas, isr):
    got = replication.in_sync(partition(spark), state(spark, *replicas), 100_000).first()
    assert got.isr == isr and got.partition_epoch == 1
    assert replication.in_sync(partition(spark), state(spark, *replicas), 100_000, dead=[2]).first().isr == [1]


def test_election_and_failover(spark):
    assert rows(replication.elect(partition(spark)), "leader_id", "leader_epoch", "error") == [(2, 1, 0)]
    assert rows(replication.elect(partition(spark, isr=(1,))), "leader_id", "error") == [(1, 0)]
    assert rows(replication.elect(partition(spark, isr=())), "leader_id", "leader_epoch", "error") == [(1, 0, 1)]
    dead = spark.createDataFrame([(2,)], "broker_id int")
    got = replication.fail_over(partition(spark, leader=2, isr=(2, 1), replicas=(2, 1)), dead).first()
    assert (got.leader_id, got.leader_epoch, got.isr, got.partition_epoch, got.error) == (1, 1, [1], 1, 0)
    assert replication.fail_over(partition(spark, leader=2, isr=(2,)), dead).first().error == 1
    assert replication.fail_over(partition(spark), dead.limit(0)).first().isr == [1, 2, 3]


def test_probes(spark):
    probes = spark.createDataFrame([(1, i, r) for i, r in enumerate((True, False, False, False, True, False))] + [(2, i, False) for i in range(2)], "broker_id int, seq long, reachable boolean")
    got = [tuple(r) for r in replication.failure_streaks(probes).filter("broker_id = 1").orderBy("seq").drop("broker_id", "seq").collect()]
    assert got[3] == (3, True, True, False) and got[4] == (0, False, False, True)
    assert rows(replication.dead_brokers(probes, 2)) == [(2,)]


@pytest.mark.parametrize("buckets", [None, 2, 5, 40])
def test_streaks_do_not_depend_on_ranges(spark, buckets):
    rng = random.Random(3)
    probes = [(b, i * 3 + b, rng.random() < {1: 0.2, 2: 0.9, 3: 0.0, 4: 1.0}[b]) for b in (1, 2, 3, 4) for i in range(120)]
    want, streak = [], {}
    for b, s, up in sorted(probes, key=lambda x: (x[0], x[1])):
        old = streak.get(b, 0)
        streak[b] = 0 if up else old + 1
        want.append((b, s, streak[b], streak[b] >= 3, streak[b] == 3, up and old >= 3))
    df = spark.createDataFrame(probes, "broker_id int, seq long, reachable boolean").repartition(5)
    assert rows(replication.failure_streaks(df, 3, buckets)) == sorted(want, key=str)


def test_segments_roll_and_are_sought(spark):
    four = spark.createDataFrame([("t", 0, i, 24) for i in range(4)], "topic string, partition int, offset long, bytes long")
    assigned = storage.assign_segments(four, 20)
    assert storage.segments(assigned).count() == 4 and rows(storage.next_offsets(assigned)) == [("t", 0, 4)]
    assert storage.segments(storage.assign_segments(four, 25)).count() == 2
    index = spark.createDataFrame([("t", 0, 0, o, p) for o, p in ((0, 0), (5, 100), (10, 200))], "topic string, partition int, segment long, offset long, file_pos long")
    wanted = spark.createDataFrame([(i, "t", 0, t) for i, t in enumerate((0, 3, 5, 7, 10, 99))] + [(6, "u", 0, 3)], "req_id int, topic string, partition int, target long")
    assert [r[1] for r in rows(storage.seek(wanted, index), "req_id", "file_pos")] == [0, 0, 100, 100, 200, 200, 0]
    every = storage.sparse_index(storage.assign_segments(four, 1000), 3)
    assert rows(every, "offset") == [(0,), (3,)]


def test_catalog(spark):
    topics, parts = catalog.create_topics(spark.createDataFrame([("a", 3), ("__x", 1)], "name string, partitions int"), [3, 1, 2])
    assert rows(parts.filter("topic = 'a'"), "partition", "leader_id", "replicas") == [(0, 1, [1, 2, 3]), (1, 2, [2, 3, 1]), (2, 3, [3, 1, 2])]
    got = catalog.describe_topics(spark.createDataFrame([("zebra",), ("a",)], "name string"), topics, parts).collect()
    assert [(r.name, r.error) for r in got] == [("a", 0), ("zebra", 3)] and len(got[0].partitions) == 3 and got[1].topic_id == catalog.ZERO_UUID
    assert catalog.metadata(None, topics, parts).count() == 2
    assert catalog.api_versions(spark).count() == 13 and catalog.api_versions(spark, 9).first().error == errors.UNSUPPORTED_VERSION
    assert catalog.topic_exists(topics, spark.createDataFrame([("a",), ("q",)], "name string")).count() == 1
    brokers = spark.createDataFrame([(1, "h", 9)], "broker_id int, host string, port int")
    assert catalog.cluster(brokers, 1).first().controller_id == 1


def test_pages_offline_replicas_and_whole_metadata(spark):
    topics, parts = catalog.create_topics(spark.createDataFrame([(n, 1) for n in "abcde"], "name string, partitions int"), [1, 2, 3])
    asked, after, seen = topics.select("name").unionByName(topics.select("name")), None, []
    for _ in range(3):
        page, after = catalog.describe_page(asked, topics, parts, 2, after, alive=[1, 3])
        seen.append([r.name for r in page.collect()])
    assert seen == [["a", "b"], ["c", "d"], ["e"]] and after is None
    assert page.first().partitions[0].offline == [2]
    got = catalog.metadata(spark.createDataFrame([("a",), ("zz",), ("a",)], "name string"), topics, parts, unknown=True)
    assert rows(got, "name", "error") == [("a", 0), ("zz", 3)]
    brokers = spark.createDataFrame([(2, "h", 9), (1, "g", 8)], "broker_id int, host string, port int")
    whole = catalog.metadata_answer(None, topics, parts, brokers, 1).first()
    assert [b.broker_id for b in whole.brokers] == [1, 2] and [t.name for t in whole.topics] == list("abcde") and whole.controller_id == 1


def test_record_mode_and_registry(spark):
    v = spark.createDataFrame([("t", 0, 0, True), ("t", 0, 0, False), ("t", 0, 1, False)], "topic string, partition int, batch int, valid boolean")
    assert rows(produce.route(v), "batch", "to_log", "to_dlq") == [(0, True, False), (0, True, True), (1, False, True)]
    assert rows(produce.route(v, "record"), "to_log") == [(False,), (False,), (True,)]
    registry = spark.createDataFrame([("t", {"a": "string"}), ("u", {"b": "null"})], "topic string, schema map<string,string>")
    new = spark.createDataFrame([("t", {"c": "number"})], "topic string, schema map<string,string>")
    assert rows(produce.register(registry, new)) == [("t", {"c": "number"}), ("u", {"b": "null"})]
