"""Committed offsets, list offsets and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors
from .logview import latest

EARLIEST, LATEST = -2, -1


def list_offsets(requests: DataFrame, ends: DataFrame) -> DataFrame:
    """(req_id, topic, partition, error, timestamp, offset) of requests (req_id, topic, partition, timestamp).

    The earliest offset is 0; any other timestamp gives the next offset. Unknown partitions are error 3.
    """
    found = requests.join(ends, ["topic", "partition"], "left")
    known = F.col("next_offset").isNotNull()
    offset = F.when(~known, -1).when(F.col("timestamp") == EARLIEST, 0).otherwise(F.col("next_offset"))
    return found.select(
        "req_id", "topic", "partition", F.when(known, errors.NONE).otherwise(errors.UNKNOWN_TOPIC_OR_PARTITION).alias("error"),
        F.when(known & (F.col("timestamp") == EARLIEST), EARLIEST).otherwise(LATEST).cast("long").alias("timestamp"), offset.cast("long").alias("offset"),
    )


def replay(commits: DataFrame) -> DataFrame:
    """(group, topic, partition, offset): of commits with a seq the last one, whatever its offset."""
    return latest(commits.select("group", "topic", "partition", "seq", "offset"), ["group", "topic", "partition"], "seq").drop("seq")


def commit(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Offset commits with their error: no such group 15, unknown member 25, other generation 22, else 0.

    ``members`` has group, member, generation. Commits without an error are what ``replay`` takes in. That the topic
    exists is not checked.
    """
    groups = members.groupBy("group").agg(F.max("generation").alias("group_generation"))
    known = members.select("group", "member", F.lit(True).alias("is_member"))
    found = requests.join(groups, "group", "left").join(known, ["group", "member"], "left")
    error = (
        F.when(F.col("group_generation").isNull(), errors.COORDINATOR_UNAVAILABLE).when(F.col("is_member").isNull(), errors.UNKNOWN_MEMBER)
        .when(F.col("generation") != F.col("group_generation"), errors.ILLEGAL_GENERATION).otherwise(errors.NONE)
    )
    return found.withColumn("error", error).drop("group_generation", "is_member")


def fetch_offsets(requests: DataFrame, committed: DataFrame) -> DataFrame:
    """(group, topic, partition, offset, metadata, error) of requests; -1 where nothing is committed, never an error."""
    found = requests.join(committed, ["group", "topic", "partition"], "left")
    return found.select("group", "topic", "partition", F.coalesce("offset", F.lit(-1)).cast("long").alias("offset"), F.lit("").alias("metadata"), F.lit(errors.NONE).alias("error"))


def lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """(group, topic, partition, lag): next offset less the committed one. Derived; no API returns it."""
    behind: Column = F.col("next_offset") - F.greatest(F.col("offset"), F.lit(0))
    return committed.join(ends, ["topic", "partition"]).select("group", "topic", "partition", F.greatest(behind, F.lit(0)).cast("long").alias("lag"))
