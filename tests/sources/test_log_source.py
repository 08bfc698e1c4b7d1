import os
import uuid

import pytest
from pyspark.sql import functions as F

from loomlog.functions import codec
from loomlog.operators import offsets
from loomlog.sources import batches, files, log_source


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(log_source.LogDataSource)
    files.seed_topics(spark).repartition("topic", "partition").write.format("log").option("path", str(tmp_path)).mode("append").save()
    return str(tmp_path)


def test_written_records_are_read_back(spark, root):
    want = sorted(map(tuple, files.seed_topics(spark).select("topic", "partition", "batch_offset", "record_index", "timestamp_ms", "key", "value").collect()), key=str)
    got = sorted(map(tuple, spark.read.format("log").option("path", root).load().collect()), key=str)
    assert got == want and len(got) == 21
    late = spark.read.format("log").option("path", root).option("startOffset", 3).load()
    assert sorted({r.batch_offset for r in late.collect()}) == [3, 4]
    assert log_source._ends(root) == {"events-0": 3, "events-1": 3, "orders-0": 5, "orders-1": 5, "orders-2": 5}


RECORDS = "topic string, partition int, batch_offset long, record_index int, timestamp_ms long, key binary, value binary"


def batch(spark, *values, first=0):
    return spark.createDataFrame([("t", 0, first + i, 0, 0, None, v) for i, v in enumerate(values)], RECORDS).coalesce(1)


def append(df, path, mode="append", **options):
    df.write.format("log").option("path", str(path)).options(**options).mode(mode).save()


def test_appends_go_on_from_the_end_and_replace_nothing(spark, root, tmp_path_factory):
    path = tmp_path_factory.mktemp("appends")
    for values in ((b"first", b"second"), (b"third",), (b"fourth",)):
        append(batch(spark, *values), path)  # each begins at offset 0 by its own numbers
    got = sorted((r.batch_offset, bytes(r.value)) for r in spark.read.format("log").option("path", str(path)).load().collect())
    assert got == [(0, b"first"), (1, b"second"), (2, b"third"), (3, b"fourth")] and log_source._ends(str(path)) == {"t-0": 4}
    append(batch(spark, b"new", first=50), path, "overwrite")
    assert [(r.batch_offset, bytes(r.value)) for r in spark.read.format("log").option("path", str(path)).load().collect()] == [(0, b"new")]


def test_segments_roll_at_their_limit(spark, root, tmp_path_factory):
    path = tmp_path_factory.mktemp("rolls")
    append(batch(spark, *[b"12345678"] * 7), path, segmentBytes=150)  # a batch is a little over 70 bytes
    assert log_source.segment_bases(str(path / "t-0")) == [0, 3, 6] or log_source.segment_bases(str(path / "t-0")) == [0, 2, 4, 6]
    assert log_source._ends(str(path)) == {"t-0": 7}
    known = {}
    assert log_source._ends(str(path), known) == {"t-0": 7} == log_source._ends(str(path), known)


def test_a_write_that_cannot_be_placed_fails_and_leaves_nothing(spark, root, tmp_path_factory):
    path = tmp_path_factory.mktemp("refused")
    append(batch(spark, b"one"), path)
    writer = log_source.LogWriter({"path": str(path)}, False)
    part = path / "t-0" / "x.part"
    part.write_bytes(codec.encode_batch([codec.Record(b"late")], 1))
    append(batch(spark, b"two"), path)
    message = log_source.Written([(str(part), log_source.segment_path(str(path / "t-0"), 1))])
    with pytest.raises(RuntimeError):
        writer.commit([message])
    writer.abort([message])
    spread = batch(spark, b"a", b"b", b"c", b"d").repartition(2, "value")
    if len({r[0] for r in spread.select(F.spark_partition_id()).collect()}) > 1:
        with pytest.raises(Exception, match="several tasks"):
            append(spread, path)
    with pytest.raises(Exception, match="must not be null"):
        append(spark.createDataFrame([("t", 0, None, 0, 0, None, b"x")], RECORDS), path)
    assert sorted(bytes(r.value) for r in spark.read.format("log").option("path", str(path)).load().collect()) == [b"one", b"two"]
    assert not [n for n in os.listdir(path / "t-0") if n.endswith(".part")]


def test_reads_begin_where_the_index_says(spark, root, tmp_path_factory):
    path = tmp_path_factory.mktemp("indexed")
    append(batch(spark, *[b"x" * i for i in range(1, 40)]), path)
    folder = str(path / "t-0")
    places = {b.base_offset: at for at, b in log_source.batches_of(log_source.segment_path(folder, 0))}
    index = log_source.index_path(folder, 0)
    assert [log_source.index_position(index, t) for t in (0, 1, 17, 38, 99)] == [places[0], places[1], places[17], places[38], places[38]]
    assert log_source.index_position(index, -1) == 0 == log_source.index_position(index + "none", 7)
    segment = log_source.Segment("t", 0, log_source.segment_path(folder, 0), 30, 33)
    assert [r[2] for r in segment.rows()] == [30, 31, 32]
    os.remove(index)
    assert [r[2] for r in segment.rows()] == [30, 31, 32]


def test_spilled_rows_come_back_in_order():
    rows = log_source._Sorted(3)
    for i in (5, 1, 4, 9, 2, 8, 0, 3):
        rows.add(("t", 0, i, 0, 0, None, b""))
    assert [r[2] for r in rows] == [0, 1, 2, 3, 4, 5, 8, 9]


def test_segments_are_pruned_and_others_ignored(spark, root):
    folder = os.path.join(root, "orders-0")
    with open(log_source.segment_path(folder, 5), "wb") as f:
        f.write(codec.encode_batch([codec.Record(b"a"), codec.Record(b"b")], 5) + codec.encode_batch([codec.Record(b"c")], 6)[:-1])
    for name in ("broker-1", "__cluster_metadata-0", "nohyphen"):
        os.makedirs(os.path.join(root, name))
    assert [s.file[-24:] for s in log_source._segments(root, {"orders-0": 5}, None) if s.topic == "orders" and s.partition == 0] == ["00000000000000000005.log"]
    got = spark.read.format("log").option("path", root).option("startOffset", 5).load().collect()
    assert [(r.batch_offset, r.record_index, bytes(r.value)) for r in got] == [(5, 0, b"a"), (5, 1, b"b")]
    assert log_source._ends(root)["orders-0"] == 7
    assert log_source.read_from(os.path.join(root, "none")) == b"" and log_source.segment_bases(os.path.join(root, "none")) == []


def test_stream_reads_what_is_new(spark, root, tmp_path_factory):
    other = tmp_path_factory.mktemp("stream")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def run():
        q = spark.readStream.format("log").option("path", root).load().writeStream.format("parquet").option("path", str(other / "out")).option("checkpointLocation", str(other / "ck")).start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(str(other / "out")).count()

    assert run() == 21
    with open(log_source.segment_path(os.path.join(root, "events-1"), 3), "wb") as f:
        f.write(codec.encode_batch([codec.Record(b"new")], 3))
    assert run() == 22


def test_segment_files_as_binary_columns(spark, root):
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(root)
    assert batches.segment_records(raw).count() == 21
    assert {r.directory: r.next_offset for r in batches.recovered_offsets(raw).collect()} == log_source._ends(root)


def test_topic_records_of_cluster_metadata(spark, tmp_path):
    ids = [str(uuid.uuid4()) for _ in range(3)]
    values = [codec.encode_topic_record("a", ids[0]), b"\1\3\0x", codec.encode_topic_record("b", ids[1]), codec.encode_topic_record("a", ids[2])]
    (tmp_path / "00000000000000000000.log").write_bytes(b"".join(codec.encode_batch([codec.Record(v)], i) for i, v in enumerate(values)))
    found = batches.topic_records(spark.read.format("binaryFile").load(str(tmp_path)))
    last = found.groupBy("name").agg(F.max_by("topic_id", "position").alias("topic_id"))
    assert {r.name: r.topic_id for r in last.collect()} == {"a": ids[2], "b": ids[1]}


def test_offset_log_replays_in_write_order(spark, tmp_path):
    path = str(tmp_path / "commits")
    order = [7, 3, 9, 1, 9, 2, 8, 2, 40, 5, 6, 4, 33, 0, 12, 11, 10, 30, 22, 17]
    for n in order:
        files.append_offset_log(spark.createDataFrame([("g", "t", 0, 1000), ("g", "t", 0, n), ("g", "t", 1, n)], files.COMMIT).coalesce(1), path)
    log = files.read_offset_log(spark, path)
    assert log.count() == 60 and {(r.partition, r.offset) for r in offsets.replay(log).collect()} == {(0, 17), (1, 17)}


def test_offset_log_and_properties(spark, tmp_path):
    path = str(tmp_path / "offsets")
    files.append_offset_log(spark.createDataFrame([("g", "t", 0, 100)], files.COMMIT), path)
    (tmp_path / "offsets" / "z.json").write_text('{"group":"g","topic":"t","partition":0,"offset":200}\nbroken\n{"group":"g"}\n')
    log = files.read_offset_log(spark, path)
    assert sorted(r.offset for r in log.collect()) == [100, 200]
    assert files.log_dirs("# a\n log.dirs = /x=y \nother=1\n\nnothing") == "/x=y" and files.log_dirs("") is None
