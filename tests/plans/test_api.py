from loomlog.plans.api import Engine, FetchPartition, GroupEvent, ProduceBatch


def test_produce_fetch_and_dead_letters(spark):
    e = Engine.create(spark, {"t": 1})
    e, answer = e.produce([ProduceBatch("t", 0, ('{"a":1}',)), ProduceBatch("none", 0, ("x",)), ProduceBatch("t", 0, ())], 5)
    assert [(r.req_id, r.error, r.base_offset) for r in answer.orderBy("req_id").collect()] == [(0, 0, 0), (1, 3, -1), (2, 0, 1)]
    e, answer = e.produce([ProduceBatch("t", 0, ('{"a":2}', '{"a":"bad"}')), ProduceBatch("t", 0, ("worse",))], 6)
    assert [(r.req_id, r.base_offset, r.written) for r in answer.orderBy("req_id").collect()] == [(0, 1, True), (1, 2, False)]
    response, records = e.fetch([FetchPartition(0, 0, "t"), FetchPartition(0, 0, "t.dlq"), FetchPartition(9, 0, "t")])
    assert [(r.part_pos, r.error, r.n_records) for r in response.orderBy("part_pos").collect()] == [(0, 0, 3), (1, 0, 2), (2, 3, 0)]
    assert sorted(r.value for r in records.collect() if r.topic == "t.dlq") == ["worse", '{"a":"bad"}']
    assert [(r.error, r.offset) for r in e.list_offsets([("t", 0, -2), ("t", 0, -1), ("q", 0, -1)]).orderBy("req_id").collect()] == [(0, 0), (0, 2), (3, -1)]
    assert {r.name for r in e.metadata().collect()} == {"t", "t.dlq"} and e.describe_topic_partitions(["zz"]).first().error == 3
    assert e.api_versions().count() == 13 and e.find_coordinator().first().node_id == 1


def test_groups_and_commits(spark):
    e = Engine.create(spark, {"t": 1})
    e, results = e.group(GroupEvent("g", "m", "join", 0, protocols=("range",)), GroupEvent("g", "m", "sync", 1, 1, payload='{"m": "p"}'), GroupEvent("g", "m", "heartbeat", 2, 1), delay_ms=0)
    assert [(r.event, r.error) for r in results.orderBy("seq").collect()] == [("join", 0), ("sync", 0), ("heartbeat", 0)]
    e, answer = e.offset_commit([("g", "m", 1, "t", 0, 42), ("g", "x", 1, "t", 0, 1), ("g", "m", 7, "t", 0, 2), ("h", "m", 1, "t", 0, 3)])
    assert [r.error for r in answer.orderBy("seq").collect()] == [0, 25, 22, 15]
    assert [(r.partition, r.offset) for r in e.offset_fetch([("g", "t", 0), ("g", "t", 1)]).orderBy("partition").collect()] == [(0, 42), (1, -1)]
    e, results = e.group(GroupEvent("g", "m", "leave", 9, 1), delay_ms=0)
    assert results.filter("event = 'leave'").first().error == 0


def test_watermark_follows_the_in_sync_replicas_and_state_is_written(spark, tmp_path):
    e = Engine.create(spark, {"t": 1}, ((1, "a", 1), (2, "b", 2)), str(tmp_path))
    for i in range(3):
        e, _ = e.produce([ProduceBatch("t", 0, (f'{{"n":{i}}}',))], i)
    assert e.fetch([FetchPartition(0, 0, "t")])[0].first().hw == 0  # broker 2 is in sync and has fetched nothing
    e = e.replica_fetched([("t", 0, 2, 2)])
    response, records = e.fetch([FetchPartition(0, 0, "t")])
    assert (response.first().hw, records.count()) == (2, 2)
    assert e.fetch([FetchPartition(0, 0, "t")], replica_id=2)[1].count() == 3
    e = e.replica_fetched([("t", 0, 2, 3)])
    assert e.fetch([FetchPartition(0, 0, "t")])[1].count() == 3
    plan = e.log._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
