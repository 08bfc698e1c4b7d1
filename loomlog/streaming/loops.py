"""The brokers' background loops as streams: followers copying a log, in-sync maintenance, health checks with failover.

Each loop is the batch operator applied to one micro-batch and to state tables with a version for every epoch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import replication
from . import tables

PARTITIONS = "topic string, partition int, leader_id int, replicas array<int>, isr array<int>, leader_epoch int, partition_epoch int, hw long"
REPLICAS = "topic string, partition int, broker_id int, leo long, last_seen_ms long"
BROKERS = "broker_id int, failures int, alive boolean"


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow(spark: SparkSession, leader_root: str, replica_root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Copies what is new in a leader's log to a replica's, at the same offsets. The data source ``log`` must be registered.

    Batches that the replica has already are passed over, so a micro-batch that is run again adds nothing.
    """
    def copy(records: DataFrame, epoch: int) -> None:
        dealt = records.repartition("topic", "partition")
        dealt.write.format("log").option("path", replica_root).option("keepOffsets", "true").mode("append").save()

    return _run(spark.readStream.format("log").option("path", leader_root).load(), copy, checkpoint, once)


def maintain(fetches: DataFrame, partitions: DataFrame, state_path: str, checkpoint: str, now_ms: Callable[[], int] | None = None, once: bool = True,
             lag_ms: int = replication.LAG_MS, lag_offsets: int = replication.LAG_OFFSETS) -> StreamingQuery:
    """In-sync sets and high watermarks from a stream of replica fetches (see ``replication.replica_progress``).

    ``partitions`` is where the first epoch starts. ``state_path`` gets the tables replicas and partitions.
    """
    clock = now_ms or (lambda: int(time.time() * 1000))

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        replicas = replication.replica_progress(tables.before(spark, f"{state_path}/replicas", epoch, REPLICAS), batch)
        replicas = tables.put(replicas.select(*_names(REPLICAS)), f"{state_path}/replicas", epoch)
        tables.put(isr_step(_now(spark, state_path, epoch, partitions), replicas, clock(), lag_ms, lag_offsets), f"{state_path}/partitions", epoch)

    return _run(fetches, step, checkpoint, once)


def isr_step(partitions: DataFrame, replicas: DataFrame, now_ms: int, lag_ms: int = replication.LAG_MS, lag_offsets: int = replication.LAG_OFFSETS) -> DataFrame:
    """The partitions after one check of all in-sync sets; the high watermarks follow the new sets."""
    now = replication.in_sync(partitions, replicas, now_ms, lag_ms, lag_offsets)
    after = partitions.drop("isr", "partition_epoch").join(now, ["topic", "partition"])
    return after.drop("hw").join(replication.high_watermark(after, replicas), ["topic", "partition"]).select(*_names(PARTITIONS))


def control(probes: DataFrame, partitions: DataFrame, state_path: str, checkpoint: str, threshold: int = replication.FAILURES, once: bool = True) -> StreamingQuery:
    """Health checks with failover from a stream of probes (broker_id, seq, reachable).

    A broker dies once its probes have failed ``threshold`` times in a row, and lives again after one that reached it. Partitions
    fail over when a broker dies. ``state_path`` gets the tables brokers and partitions.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = tables.before(spark, f"{state_path}/brokers", epoch, BROKERS)
        new = tables.put(health_step(old, batch, threshold), f"{state_path}/brokers", epoch)
        was = old.filter("NOT alive").select("broker_id")
        dead = new.filter("NOT alive").select("broker_id").join(was, "broker_id", "left_anti")
        now = _now(spark, state_path, epoch, partitions)
        after = now.drop("leader_id", "leader_epoch", "isr", "partition_epoch").join(replication.fail_over(now, dead).drop("error"), ["topic", "partition"])
        tables.put(after.select(*_names(PARTITIONS)), f"{state_path}/partitions", epoch)

    return _run(probes, step, checkpoint, once)


def health_step(brokers: DataFrame, probes: DataFrame, threshold: int = replication.FAILURES) -> DataFrame:
    """BROKERS after a batch of probes: failures in a row so far, and whether the broker lives. Aggregates only."""
    last = probes.groupBy("broker_id").agg(F.max(F.when(F.col("reachable"), F.col("seq"))).alias("ok"))
    since = probes.join(last, "broker_id").groupBy("broker_id").agg(
        F.sum((F.col("ok").isNull() | (F.col("seq") > F.col("ok"))).cast("int")).alias("failed"), F.max(F.col("ok").isNotNull()).alias("reached")
    )
    both = brokers.join(since, "broker_id", "full")
    failures = F.when(F.coalesce("reached", F.lit(False)), F.col("failed")).otherwise(F.coalesce("failures", F.lit(0)) + F.coalesce("failed", F.lit(0))).cast("int")
    lived = F.coalesce("alive", F.lit(True)) | F.coalesce("reached", F.lit(False))
    return both.select(F.col("broker_id").cast("int").alias("broker_id"), failures.alias("failures"), (lived & (failures < threshold)).alias("alive"))


def _now(spark: SparkSession, state_path: str, epoch: int, first: DataFrame) -> DataFrame:
    """The partitions as the epochs before have left them."""
    path = f"{state_path}/partitions"
    known = [e for e in tables.versions(spark, path) if e < epoch]
    return spark.read.schema(PARTITIONS).parquet(f"{path}/epoch={known[-1]}") if known else first.select(*_names(PARTITIONS))


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def wait_for_watermark(read: Callable[[], DataFrame], wanted: DataFrame, timeout_ms: int, step_ms: int = 5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``wanted`` (topic, partition, offset) with reached: whether the high watermark has passed the offset by the deadline.

    ``read`` gives (topic, partition, hw) as they are now. A producer that asks for all replicas waits so and then
    answers, reached or not.
    """
    began = clock()
    while True:
        out = wanted.join(read().select("topic", "partition", "hw"), ["topic", "partition"], "left")
        out = out.withColumn("reached", F.coalesce(F.col("hw") > F.col("offset"), F.lit(False))).drop("hw")
        left = timeout_ms - (clock() - began) * 1000
        if left <= 0 or out.filter("NOT reached").isEmpty():
            return out
        sleep(min(step_ms, left) / 1000)
