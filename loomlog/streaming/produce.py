"""The produce pipeline as a stream: validate, route, append and dead-letter in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import json_schema
from ..operators import produce
from ..operators.logview import assign_offsets
from . import tables


ENDS = "topic string, partition int, next_offset long"
SCHEMAS = "topic string, schema map<string,string>"


def next_offsets(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """(topic, partition, start): where an append in ``epoch`` begins, after all earlier epochs. Read from a small table beside the log."""
    return tables.before(spark, f"{path}/_ends", epoch, ENDS).withColumnRenamed("next_offset", "start")


def append(records: DataFrame, path: str, order: str, epoch: int) -> None:
    """Appends records to a table, one folder per epoch, with offsets that go on from its end.

    A repeated epoch replaces what it wrote, so a micro-batch that is run again leaves no records twice. The log's ends are
    kept as a table with a version for every epoch; only what the epoch wrote is read for it.
    """
    spark = records.sparkSession
    ends = next_offsets(spark, path, epoch)
    placed = records.join(F.broadcast(ends), ["topic", "partition"], "left").withColumn("start", F.coalesce("start", F.lit(0)))  # a row for each partition
    placed = assign_offsets(placed, ["topic", "partition"], order, start=F.col("start")).drop("start")
    written = tables.put(placed, path, epoch)
    new = written.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
    both = ends.withColumnRenamed("start", "next_offset").unionByName(new).groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"))
    tables.put(both, f"{path}/_ends", epoch)


def pipeline(log_path: str, dlq_path: str, schemas: DataFrame, order: str = "seq", mode: str = "batch", registry_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``: the batch operators applied to one micro-batch of records.

    Records have topic, partition, batch, value and a unique number ``order``. A batch must arrive within one micro-batch. With
    ``registry_path`` a topic without a schema gets that of its first value, once; the micro-batch in which it comes passes, later
    ones are validated with it. The registry is a table with a version for every epoch.
    """

    def run(records: DataFrame, epoch: int) -> None:
        spark = records.sparkSession
        json_schema.allow_duplicate_keys(spark)
        known = schemas
        if registry_path:
            known = produce.register(schemas.select("topic", "schema"), tables.before(spark, registry_path, epoch, SCHEMAS))
        routed = produce.route(produce.validate(records, known), mode).persist()
        try:
            append(routed.filter("to_log").drop("to_log", "to_dlq", "valid"), log_path, order, epoch)
            append(produce.dead_letters(routed).drop("valid"), dlq_path, order, epoch)
            if registry_path:
                new = produce.infer_schemas(routed.join(known.select("topic"), "topic", "left_anti"), order)
                tables.put(produce.register(known, new).select("topic", "schema"), registry_path, epoch)
        finally:
            routed.unpersist()

    return run


def start(records: DataFrame, log_path: str, dlq_path: str, checkpoint: str, schemas: DataFrame, order: str = "seq", mode: str = "batch", once: bool = True, registry_path: str | None = None) -> StreamingQuery:
    """Starts the pipeline on a stream of records."""
    writer = records.writeStream.foreachBatch(pipeline(log_path, dlq_path, schemas, order, mode, registry_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
