"""The write path: validation, batch-level routing, dead letters, produce responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import errors, json_schema
from ..functions.names import dlq_topic


def infer_schemas(records: DataFrame, order: str = "seq") -> DataFrame:
    """(topic, schema): the fields of each topic's first non-empty value by ``order``; topics whose value is no object have none.

    One schema per topic comes of any number of records: the first value is an aggregate.
    """
    solid = records.filter(F.length("value") > 0)
    first = solid.groupBy("topic").agg(F.min_by("value", order).alias("value"))
    return first.select("topic", json_schema.fields(F.col("value")).alias("schema")).filter(F.col("schema").isNotNull())


def register(registry: DataFrame, schemas: DataFrame) -> DataFrame:
    """A registry (topic, schema) in which ``schemas`` replace those of their topics."""
    return registry.join(schemas.select("topic"), "topic", "left_anti").unionByName(schemas)


def schema_fields(schemas: DataFrame) -> DataFrame:
    """(topic, field, type), one row per field."""
    return schemas.select("topic", F.explode("schema").alias("field", "type"))


def validate(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Records with ``valid``. Empty values and topics without a schema pass."""
    out = records.join(schemas, "topic", "left")
    empty = F.col("value").isNull() | (F.length("value") == 0)
    return out.withColumn("valid", empty | json_schema.validates(json_schema.fields(F.col("value")), F.col("schema"))).drop("schema")


def route(validated: DataFrame, mode: str = "batch", batch: tuple[str, ...] = ("topic", "partition", "batch")) -> DataFrame:
    """Records with to_log and to_dlq.

    In ``batch`` mode a batch without a valid record is not written, any other batch is written whole; invalid records go
    to the dead letters in either case. In ``record`` mode only valid records are written.
    """
    if mode == "record":
        return validated.withColumns({"to_log": F.col("valid"), "to_dlq": ~F.col("valid")})
    some = F.max("valid").over(W.partitionBy(*batch))
    return validated.withColumns({"to_log": some, "to_dlq": ~F.col("valid")})


def dead_letters(routed: DataFrame) -> DataFrame:
    """The dead letters as records of ``<topic>.dlq``, partition 0."""
    return routed.filter("to_dlq").drop("to_log", "to_dlq").withColumns({"topic": dlq_topic(F.col("topic")), "partition": F.lit(0)})


def missing_dlq_topics(routed: DataFrame, topics: DataFrame) -> DataFrame:
    """(name) of dead-letter topics that have to be created."""
    wanted = dead_letters(routed).select(F.col("topic").alias("name")).distinct()
    return wanted.join(topics, "name", "left_anti")


def respond(requests: DataFrame, partitions: DataFrame, broker_id: int, now_ms: int) -> DataFrame:
    """Produce responses of requests (req_id, topic, partition, n_records, all_failed).

    Unknown partition 3, led by another broker 6; a batch that is empty or failed as a whole succeeds at the next
    offset without being written.
    """
    found = requests.join(partitions.select("topic", "partition", "leader_id", "next_offset"), ["topic", "partition"], "left")
    error = F.when(F.col("leader_id").isNull(), errors.UNKNOWN_TOPIC_OR_PARTITION).when(F.col("leader_id") != broker_id, errors.NOT_LEADER).otherwise(errors.NONE)
    found = found.withColumn("error", error).withColumn("written", (F.col("error") == 0) & (F.col("n_records") > 0) & ~F.col("all_failed"))
    before = F.coalesce(F.sum(F.col("written").cast("long")).over(W.partitionBy("topic", "partition").orderBy("req_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = F.col("next_offset") + before
    ok = F.col("error") == 0
    return found.select(
        "req_id", "topic", "partition", "error", F.when(ok, base).otherwise(-1).cast("long").alias("base_offset"),
        F.when(ok, F.lit(now_ms)).otherwise(-1).cast("long").alias("log_append_time_ms"), F.when(ok, 0).otherwise(-1).cast("long").alias("log_start_offset"), "written",
    )
