"""High watermark, in-sync replicas, leader election and failure detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .logview import quantile_cuts, range_of

LAG_MS = 10_000
LAG_OFFSETS = 10_000
FAILURES = 3


def high_watermark(partitions: DataFrame, replica_state: DataFrame) -> DataFrame:
    """(topic, partition, hw): the least log end over the in-sync replicas, never below the old one.

    ``partitions`` has topic, partition, isr (array) and hw; ``replica_state`` topic, partition, broker_id, leo. A
    replica without a log end counts as 0; an empty in-sync set leaves the watermark as it was.
    """
    members = partitions.select("topic", "partition", F.explode("isr").alias("broker_id"))
    least = members.join(replica_state, ["topic", "partition", "broker_id"], "left").groupBy("topic", "partition").agg(F.min(F.coalesce("leo", F.lit(0))).alias("least"))
    return partitions.join(least, ["topic", "partition"], "left").select("topic", "partition", F.greatest("hw", F.coalesce("least", "hw")).cast("long").alias("hw"))


def replica_progress(replica_state: DataFrame, fetches: DataFrame) -> DataFrame:
    """Replica state after fetches (topic, partition, broker_id, delivered, error, seq, ts_ms).

    An error-free fetch moves a replica's log end behind the last delivered record; the last one by seq counts.
    """
    done = fetches.filter("error = 0").select("topic", "partition", "broker_id", F.col("delivered").alias("leo"), F.col("ts_ms").alias("last_seen_ms"), "seq")
    old = replica_state.select("topic", "partition", "broker_id", "leo", "last_seen_ms", F.lit(-1).cast("long").alias("seq"))
    return old.unionByName(done).groupBy("topic", "partition", "broker_id").agg(F.max_by("leo", "seq").alias("leo"), F.max_by("last_seen_ms", "seq").alias("last_seen_ms"))


def in_sync(partitions: DataFrame, replica_state: DataFrame, as_of_ms: int, lag_ms: int = LAG_MS, lag_offsets: int = LAG_OFFSETS, dead: list[int] | None = None) -> DataFrame:
    """(topic, partition, isr, partition_epoch): in-sync replicas in the order of the replica list.

    The leader is always in. Others leave if they were never seen, not seen for longer than ``lag_ms``, have no log end, or are
    behind the leader by more than ``lag_offsets``. Dead brokers stay out. The epoch grows only if the size changes.
    """
    spread = partitions.select("topic", "partition", "leader_id", "isr", "partition_epoch", F.posexplode("replicas").alias("place", "broker_id"))
    state = spread.join(replica_state, ["topic", "partition", "broker_id"], "left")
    leader_leo = F.max(F.when(F.col("broker_id") == F.col("leader_id"), F.coalesce("leo", F.lit(0)))).over(W.partitionBy("topic", "partition"))
    alive = ~F.col("broker_id").isin(dead) if dead else F.lit(True)
    fresh = F.coalesce((F.lit(as_of_ms) - F.col("last_seen_ms") <= lag_ms) & (F.col("leader_leo") - F.col("leo") <= lag_offsets), F.lit(False))
    state = state.withColumn("leader_leo", leader_leo).filter((F.col("broker_id") == F.col("leader_id")) | (alive & fresh))
    now = state.groupBy("topic", "partition").agg(F.array_sort(F.collect_list(F.struct("place", "broker_id"))).alias("members"))
    now = partitions.join(now, ["topic", "partition"], "left")
    isr = F.transform(F.coalesce("members", F.array().cast("array<struct<place:int,broker_id:int>>")), lambda m: m["broker_id"])
    return now.withColumn("now", isr).select(
        "topic", "partition", F.col("now").alias("isr"), (F.col("partition_epoch") + (F.size("now") != F.size("isr")).cast("int")).alias("partition_epoch")
    )


def shrink(isr: Column, broker_id: Column | int) -> Column:
    """An in-sync set without a broker."""
    return F.array_remove(isr, broker_id)


def expand(isr: Column, broker_id: Column, leo: Column, leader_leo: Column) -> Column:
    """An in-sync set with a broker that has caught up with the leader."""
    return F.when((leo >= leader_leo) & ~F.array_contains(isr, broker_id), F.array_append(isr, broker_id)).otherwise(isr)


def elect(partitions: DataFrame) -> DataFrame:
    """(topic, partition, leader_id, leader_epoch, error) after an election in every partition.

    The first in-sync replica that is not the leader, else the first one; an empty set is error 1 and changes nothing.
    """
    state = partitions.withColumn("chosen", F.coalesce(F.get(F.array_remove("isr", F.col("leader_id")), 0), F.get("isr", 0)))
    found = F.col("chosen").isNotNull()
    return state.select(
        "topic", "partition", F.coalesce("chosen", "leader_id").alias("leader_id"), (F.col("leader_epoch") + found.cast("int")).alias("leader_epoch"),
        F.when(found, 0).otherwise(1).alias("error"),
    )


def failure_streaks(probes: DataFrame, threshold: int = FAILURES, buckets: int | None = None) -> DataFrame:
    """(broker_id, seq, streak, dead, newly_dead, revived) for each probe (broker_id, seq, reachable).

    ``streak`` counts failures in a row. A broker is dead from the threshold on until a probe succeeds. A history is cut at
    quantiles of seq; streaks are counted inside the ranges, and what a range hands to the next one is a running sum over the
    small table of ranges, so a broker's history of any length is read by many tasks.
    """
    at = ["broker_id", "range_"]
    cut = probes.select("broker_id", "seq", "reachable", range_of(F.col("seq").cast("double"), quantile_cuts(probes, "seq", buckets)).alias("range_"))
    inside = W.partitionBy(*at).orderBy("seq")
    numbered = cut.withColumn("row_", F.row_number().over(inside))
    numbered = numbered.withColumn("ok_", F.max(F.when(F.col("reachable"), F.col("row_"))).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # Failures at each range's end, summed from the last range with a success on.
    tails = cut.groupBy(*at).agg(F.max(F.when(F.col("reachable"), F.col("seq"))).alias("last_"))
    tails = cut.join(tails.select(*(F.col(c).alias(f"{c}__of") for c in at), "last_"), (F.col("broker_id") == F.col("broker_id__of")) & (F.col("range_") == F.col("range___of")))
    tails = tails.groupBy(*at).agg(F.sum((F.col("last_").isNull() | (F.col("seq") > F.col("last_"))).cast("long")).alias("tail_"), F.max(F.col("last_").isNotNull().cast("int")).alias("any_"))
    by_range = W.partitionBy("broker_id").orderBy("range_")
    tails = tails.withColumn("run_", F.sum("any_").over(by_range.rowsBetween(W.unboundedPreceding, W.currentRow)))
    total = F.sum("tail_").over(W.partitionBy("broker_id", "run_").orderBy("range_").rowsBetween(W.unboundedPreceding, W.currentRow))
    carried = tails.withColumn("total_", total).select(*at, F.coalesce(F.lag("total_").over(by_range), F.lit(0)).alias("carry_"))
    out = numbered.join(carried, at)
    out = out.withColumn("streak", (F.col("row_") - F.coalesce("ok_", F.lit(0)) + F.when(F.col("ok_").isNull(), F.col("carry_")).otherwise(0)).cast("long"))
    before = F.coalesce(F.lag("streak").over(inside), F.col("carry_"))
    return out.select(
        "broker_id", "seq", "streak", (F.col("streak") >= threshold).alias("dead"), (F.col("streak") == threshold).alias("newly_dead"),
        ((F.col("streak") == 0) & (before >= threshold)).alias("revived"),
    )


def dead_brokers(probes: DataFrame, threshold: int = FAILURES) -> DataFrame:
    """(broker_id) whose last probes all failed, ``threshold`` of them or more. Aggregates only."""
    last = probes.groupBy("broker_id").agg(F.max(F.when(F.col("reachable"), F.col("seq"))).alias("ok"))
    failed = probes.join(last, "broker_id").filter(F.col("ok").isNull() | (F.col("seq") > F.col("ok")))
    return failed.groupBy("broker_id").count().filter(F.col("count") >= threshold).select("broker_id")


def fail_over(partitions: DataFrame, dead: DataFrame) -> DataFrame:
    """(topic, partition, leader_id, leader_epoch, isr, partition_epoch, error) once dead brokers have left.

    They leave every in-sync set; where one led, an election follows among those that remain.
    """
    gone = dead.agg(F.coalesce(F.collect_set("broker_id"), F.array().cast("array<int>")).alias("gone"))
    state = partitions.join(F.broadcast(gone))  # one row
    state = state.withColumn("left", F.array_except("isr", "gone")).withColumn("led", F.array_contains("gone", F.col("leader_id")))
    state = state.withColumn("chosen", F.when(F.col("led"), F.get(F.array_remove("left", F.col("leader_id")), 0)))
    moved = F.col("chosen").isNotNull()
    return state.select(
        "topic", "partition", F.coalesce("chosen", "leader_id").alias("leader_id"), (F.col("leader_epoch") + moved.cast("int")).alias("leader_epoch"),
        F.col("left").alias("isr"), (F.col("partition_epoch") + (F.size("left") != F.size("isr")).cast("int")).alias("partition_epoch"),
        F.when(F.col("led") & ~moved, 1).otherwise(0).alias("error"),
    )


def replica_work(partitions: DataFrame, broker_id: int) -> DataFrame:
    """(leader_id, topic, partitions): what a broker follows, by leader and topic."""
    mine = partitions.filter(F.array_contains("replicas", F.lit(broker_id)) & (F.col("leader_id") != broker_id))
    return mine.groupBy("leader_id", "topic").agg(F.array_sort(F.collect_list("partition")).alias("partitions"))


def replicate(log: DataFrame, replica_state: DataFrame, broker_id: int) -> DataFrame:
    """The records that a follower still has to copy: those from its own log end on, of every partition it follows."""
    mine = replica_state.filter(F.col("broker_id") == broker_id).select("topic", "partition", "leo")
    return log.join(mine, ["topic", "partition"]).filter(F.col("offset") >= F.coalesce("leo", F.lit(0))).drop("leo")
