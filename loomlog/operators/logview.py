"""Tables as logs: records with topic, partition and offset."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a record batch's header; a record of one batch takes so many besides its value.
HEADER_BYTES = 61
#: Rows of a log that one task numbers, and the most ranges that a table is cut into.
RANGE_ROWS = 2**14
MAX_RANGES = 1024


def quantile_cuts(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Ascending numbers that cut ``df`` into ranges of about RANGE_ROWS rows by a column, at most MAX_RANGES, or into ``buckets``."""
    every = [k / MAX_RANGES for k in range(1, MAX_RANGES)]
    n, found = df.agg(F.count(F.lit(1)), F.percentile_approx(F.col(order).cast("double"), every, 10 * MAX_RANGES)).first()
    wanted = min(MAX_RANGES, buckets or n // RANGE_ROWS)
    return sorted({found[round(k * len(found) / wanted) - 1] for k in range(1, wanted)}) if found else []


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are at most ``value``, by a binary search written as nested conditions."""
    if not cuts:
        return F.lit(0)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(cuts[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(cuts))


def assign_offsets(df: DataFrame, keys: list[str], order: str, buckets: int | None = None, start: Column | None = None) -> DataFrame:
    """Adds ``offset``: the row's number in its log, by ``order`` (a unique number), from 0 or from ``start``.

    Each log is cut at quantiles of the order column. Ranges are counted, a prefix sum over the small
    table of counts gives their first offsets, and rows are numbered inside their range: a log of any
    length is numbered by many tasks, and no outlier empties the others. There is a range for every RANGE_ROWS rows, at most
    MAX_RANGES, or ``buckets`` of them. Null keys are a log like any other; rows without an order come last.
    """
    cuts = quantile_cuts(df, order, buckets)
    place = F.col(order).asc_nulls_last()
    if not cuts:
        number = F.row_number().over(W.partitionBy(*keys).orderBy(place)) - 1
        return df.withColumn("offset", (number + (F.lit(0) if start is None else start)).cast("long"))
    last = F.lit(len(cuts) + 1)
    cut = df.withColumn("range_", F.when(F.col(order).isNull(), last).otherwise(range_of(F.col(order).cast("double"), cuts)))
    before = F.coalesce(F.sum("n_").over(W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = cut.groupBy(*keys, "range_").agg(F.count(F.lit(1)).alias("n_"))
    names = {k: f"{k}__of" for k in [*keys, "range_"]}
    counts = counts.select(*(F.col(k).alias(v) for k, v in names.items()), before.alias("before_"))
    inside = F.row_number().over(W.partitionBy(*keys, "range_").orderBy(place)) - 1
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()))
    out = cut.withColumn("inside_", inside).join(counts, same).drop(*names.values())
    offset = F.col("before_") + F.col("inside_") + (F.lit(0) if start is None else start)
    return out.withColumn("offset", offset.cast("long")).drop("range_", "inside_", "before_")


def event_log(events: DataFrame, partitions: int = 3, topic: str = "events") -> DataFrame:
    """The events table as one topic: partition by user, order by event id, one record per batch."""
    parts = events.withColumn("partition", (F.col("user_id") % partitions).cast("int"))
    return assign_offsets(parts, ["partition"], "event_id").select(
        F.lit(topic).alias("topic"), "partition", "offset", F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts_ms"),
        (F.lit(HEADER_BYTES) + F.octet_length("props")).cast("long").alias("bytes"), "event_id", "user_id", "event_type",
    )


def log_ends(log: DataFrame) -> DataFrame:
    """(topic, partition, next_offset) of a log."""
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``: replay with the last write winning. Partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last_")).select(*keys, "last_.*")
