"""Bounded range scans of the log with a byte budget, epoch fencing and response shapes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import errors

UNLIMITED = 2**31 - 1
#: Between two attempts of a poll.
POLL_MS = 5


def resolve_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Requests with topic and topic_id filled in from the catalog: by name if there is one, else by id.

    Both lookups are equi joins; a request of neither keeps its values and gets known = false.
    """
    named = F.coalesce(F.col("topic"), F.lit("")) != ""
    by_name = topics.select(F.col("name").alias("n_name"), F.col("topic_id").alias("n_id"))
    by_id = topics.select(F.col("name").alias("i_name"), F.col("topic_id").alias("i_id"))
    out = requests.join(by_name, named & (F.col("topic") == F.col("n_name")), "left").join(by_id, ~named & (F.col("topic_id") == F.col("i_id")), "left")
    out = out.withColumn("known", F.coalesce("n_name", "i_name").isNotNull())
    out = out.withColumns({"topic": F.coalesce("n_name", "i_name", "topic"), "topic_id": F.coalesce("n_id", "i_id", "topic_id")})
    return out.drop("n_name", "n_id", "i_name", "i_id")


def fence(epoch: Column, leader_epoch: Column, replica: Column) -> Column:
    """Error of a request's epoch: older than the leader's is fenced, newer ones only fail for consumers; -1 skips the check."""
    return F.when((epoch >= 0) & (epoch < leader_epoch), errors.FENCED_EPOCH).when((epoch >= 0) & (epoch > leader_epoch) & ~replica, errors.NOT_LEADER).otherwise(errors.NONE)


def plan(requests: DataFrame, partitions: DataFrame) -> DataFrame:
    """Requests with error and limit: consumers read up to the high watermark, replicas up to the log end.

    ``requests`` has topic_pos, part_pos, topic, topic_id, partition, fetch_offset, epoch, replica_id (-1 for consumers) and
    known, see ``resolve_topics``; ``partitions`` has topic, partition, leader_epoch, hw and leo. A topic that is not found, by
    name or id, is error 100, a partition that it does not have error 3.
    """
    found = requests.join(partitions.select("topic", "partition", "leader_epoch", "hw", "leo"), ["topic", "partition"], "left")
    replica = F.col("replica_id") >= 0
    error = F.when(~F.col("known"), errors.UNKNOWN_TOPIC_ID).when(F.col("hw").isNull(), errors.UNKNOWN_TOPIC_OR_PARTITION).otherwise(fence(F.col("epoch"), F.col("leader_epoch"), replica))
    return found.withColumn("error", error).withColumn("limit", F.when(F.col("error") == 0, F.when(replica, F.col("leo")).otherwise(F.col("hw"))))


def scan(planned: DataFrame, log: DataFrame) -> DataFrame:
    """Records of each error-free request: offsets from fetch_offset up to the limit, exactly."""
    wanted = planned.filter("error = 0 AND fetch_offset < limit").select("topic_pos", "part_pos", "topic", "partition", "fetch_offset", "limit")
    out = log.join(wanted, ["topic", "partition"]).filter((F.col("offset") >= F.col("fetch_offset")) & (F.col("offset") < F.col("limit")))
    return out.drop("fetch_offset", "limit")


def within_budget(records: DataFrame, max_bytes: int, range_size: int = 65_536) -> DataFrame:
    """The records that a response of ``max_bytes`` holds, in request order, with returned_bytes; the one that crosses is cut.

    No budget (0 or less) means 2 ** 31 - 1. Partitions of the request are summed first, then ranges of offsets in
    those that begin within the budget, and only records of ranges that do so are numbered one by one. So each prefix sum
    runs over as many rows as a request has partitions, or a partition ranges.
    """
    budget = max_bytes if max_bytes > 0 else UNLIMITED
    asked, place = ["topic_pos", "part_pos"], ["topic_pos", "part_pos", "range_"]
    upto = lambda w: F.coalesce(F.sum("s_").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = records.withColumn("range_", F.floor(F.col("offset") / range_size))
    ranges = cut.groupBy(*place).agg(F.sum("bytes").alias("s_"))
    first = ranges.groupBy(*asked).agg(F.sum("s_").alias("s_")).withColumn("first_", upto(W.orderBy(*asked))).filter(F.col("first_") < budget)
    ranges = ranges.join(F.broadcast(first.select(*asked, "first_")), asked)  # a row for each partition of the request
    ranges = ranges.withColumn("before_", F.col("first_") + upto(W.partitionBy(*asked).orderBy("range_"))).filter(F.col("before_") < budget).drop("s_", "first_")
    inside = F.coalesce(F.sum("bytes").over(W.partitionBy(*place).orderBy("offset").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = cut.join(ranges, place).withColumn("before_", F.col("before_") + inside).filter(F.col("before_") < budget)
    return out.withColumn("returned_bytes", F.least("bytes", budget - F.col("before_")).cast("long")).drop("range_", "before_")


def response(planned: DataFrame, records: DataFrame) -> DataFrame:
    """One row per request: topic_id, partition, error, hw, last_stable, log_start, preferred_replica, n_records, bytes.

    The watermark is -1 only where there is no partition; last_stable and log_start are -1 with any error.
    """
    sums = records.groupBy("topic_pos", "part_pos").agg(F.count(F.lit(1)).alias("n_records"), F.sum("returned_bytes").alias("bytes"))
    ok = F.col("error") == 0
    return planned.join(sums, ["topic_pos", "part_pos"], "left").select(
        "topic_pos", "part_pos", "topic", "topic_id", "partition", "error", F.coalesce(F.when(F.col("known"), F.col("hw")), F.lit(-1)).cast("long").alias("hw"),
        F.when(ok, F.col("hw")).otherwise(-1).cast("long").alias("last_stable"), F.when(ok, 0).otherwise(-1).cast("long").alias("log_start"), F.lit(-1).alias("preferred_replica"),
        F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
    )


def response_v0(planned: DataFrame, records: DataFrame) -> DataFrame:
    """The older shape: topic, partition, error, hw, n_records, bytes."""
    return response(planned, records).select("topic_pos", "part_pos", "topic", "partition", "error", "hw", "n_records", "bytes")


def with_records(answer: DataFrame, records: DataFrame) -> DataFrame:
    """``answer`` with records: an array of (offset, key, value, returned_bytes) in order of offset, null where there are none.

    The byte budget bounds what an answer's arrays hold together.
    """
    packed = records.groupBy("topic_pos", "part_pos").agg(F.sort_array(F.collect_list(F.struct("offset", "key", "value", "returned_bytes"))).alias("records"))
    return answer.join(packed, ["topic_pos", "part_pos"], "left")


def fetch(requests: DataFrame, topics: DataFrame, partitions: DataFrame, log: DataFrame, max_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(response rows, records) of a fetch."""
    planned = plan(resolve_topics(requests, topics), partitions)
    records = within_budget(scan(planned, log), max_bytes)
    return response(planned, records), records


def ready(records: DataFrame, min_bytes: int, waited_ms: int, max_wait_ms: int) -> bool:
    """Whether a poll may answer: enough bytes (1 if none are asked for) or the time is up."""
    return waited_ms >= max_wait_ms or (records.agg(F.sum("bytes")).first()[0] or 0) >= (min_bytes if min_bytes > 0 else 1)


def poll(attempt: Callable[[], tuple[DataFrame, DataFrame]], min_bytes: int = 1, max_wait_ms: int = 0, step_ms: int = POLL_MS, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """The first answer of ``attempt`` (as ``fetch`` gives it, over the log as it is then) that holds ``min_bytes``, or that at the deadline."""
    began = clock()
    while True:
        answer, records = attempt()
        waited = (clock() - began) * 1000
        if ready(records.withColumn("bytes", F.col("returned_bytes")), min_bytes, waited, max_wait_ms):
            return answer, records
        sleep(min(step_ms, max_wait_ms - waited) / 1000)
