"""Segment layout, sparse index and recovery as queries over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names

MAX_SEGMENT_BYTES = 2**30


def assign_segments(batches: DataFrame, max_bytes: int = MAX_SEGMENT_BYTES) -> DataFrame:
    """(topic, partition, offset, bytes, segment, file_pos) of batches (topic, partition, offset, bytes).

    A batch opens a new segment, named by its offset, if the current one has reached ``max_bytes`` before it
    is written; a segment may so exceed the limit by one batch. Each log is a fold in offset order that
    keeps two numbers: tasks stream over sorted rows and hold one Arrow batch, in which only the segments are looped
    over. Where a segment ends follows from all before it, so a log is folded by one task; logs are many.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, base, size = None, 0, 0
        for part in parts:
            topics, partitions = part.column(0).dictionary_encode().indices.to_numpy(), part.column(1).to_numpy()
            names, offsets, sizes = part.column(0), part.column(2).to_numpy(), part.column(3).to_numpy()
            segments, places = np.empty(part.num_rows, np.int64), np.empty(part.num_rows, np.int64)
            cuts = np.flatnonzero((topics[1:] != topics[:-1]) | (partitions[1:] != partitions[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows], strict=True):
                if low == high:
                    continue
                if (name := (names[low].as_py(), int(partitions[low]))) != log:
                    log, base, size = name, int(offsets[low]), 0
                ends = np.cumsum(sizes[low:high])
                at = 0  # the batch at which the current segment, or its rest, begins
                while at < high - low:
                    if size >= max_bytes:
                        base, size = int(offsets[low + at]), 0
                    before = int(ends[at - 1]) if at else 0
                    after = min(int(np.searchsorted(ends, before + max_bytes - size)) + 1, high - low)  # up to the batch that fills it
                    segments[low + at : low + after] = base
                    places[low + at : low + after] = size + ends[at:after] - sizes[low + at : low + after] - before
                    size += int(ends[after - 1]) - before
                    at = after
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(segments), pa.array(places)], [*part.schema.names, "segment", "file_pos"])

    rows = batches.select(F.col("topic").cast("string"), F.col("partition").cast("int"), F.col("offset").cast("long"), F.col("bytes").cast("long"))
    rows = rows.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    return rows.mapInArrow(fold, "topic string, partition int, offset long, bytes long, segment long, file_pos long")


def segments(assigned: DataFrame) -> DataFrame:
    """(topic, partition, base_offset, file, batches, bytes), one row per segment."""
    out = assigned.groupBy("topic", "partition", F.col("segment").alias("base_offset")).agg(F.count(F.lit(1)).alias("batches"), F.sum("bytes").alias("bytes"))
    return out.select("topic", "partition", "base_offset", names.segment_file(F.col("base_offset")).alias("file"), "batches", "bytes")


def sparse_index(assigned: DataFrame, interval: int = 1) -> DataFrame:
    """(topic, partition, segment, offset, file_pos): an entry for every ``interval``-th batch of a segment, the first included."""
    entries = assigned.select("topic", "partition", "segment", "offset", "file_pos")
    if interval <= 1:
        return entries
    number = F.row_number().over(W.partitionBy("topic", "partition", "segment").orderBy("offset")) - 1
    return entries.withColumn("number_", number).filter(F.col("number_") % interval == 0).drop("number_")


def seek(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(req_id, topic, partition, target, segment, file_pos): where to start reading for an offset.

    The last segment that starts at or before the target, and in it the last entry at or before it; without
    one, the first segment (null if there is none at all) at position 0. Two equi joins and aggregates; only
    the wanted segments' entries reach the second one.
    """
    starts = index.groupBy("topic", "partition", "segment").agg(F.lit(1).alias("one")).drop("one")
    by_log = requests.join(starts, ["topic", "partition"], "left").groupBy("req_id", "topic", "partition", "target")
    last = F.max(F.when(F.col("segment") <= F.col("target"), F.col("segment")))
    found = by_log.agg(F.coalesce(last, F.min("segment")).alias("segment"))
    entries = found.join(index, ["topic", "partition", "segment"], "left")
    place = F.max(F.when(F.col("offset") <= F.col("target"), F.struct("offset", "file_pos")))
    out = entries.groupBy("req_id", "topic", "partition", "target", "segment").agg(place.alias("place"))
    return out.select("req_id", "topic", "partition", "target", "segment", F.coalesce("place.file_pos", F.lit(0)).cast("long").alias("file_pos"))


def next_offsets(assigned: DataFrame) -> DataFrame:
    """(topic, partition, next_offset): the last segment's base and the number of its batches."""
    counts = assigned.groupBy("topic", "partition", "segment").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("topic", "partition").agg(F.max(F.struct("segment", "n")).alias("last")).select(
        "topic", "partition", (F.col("last.segment") + F.col("last.n")).cast("long").alias("next_offset")
    )


def list_segments(files: DataFrame) -> DataFrame:
    """(directory, base_offset, name) of the segment files among (directory, name), in order of base offset."""
    base = names.segment_base(F.col("name"))
    return files.select("directory", base.alias("base_offset"), "name").filter(F.col("base_offset").isNotNull()).orderBy("directory", "base_offset")


def recover_catalog(directories: DataFrame, topic_ids: DataFrame) -> DataFrame:
    """(topic, topic_id, partition, on_disk) from directory names (name) and known ids (name, topic_id).

    Broker directories, internal topics and names without a number after their last hyphen are skipped. Gaps
    between partition 0 and the last one are filled. A topic without a known id gets one made of its name.
    """
    found = directories.filter(names.is_topic_directory(F.col("name"))).select(
        names.directory_topic(F.col("name")).alias("topic"), names.directory_partition(F.col("name")).alias("partition")
    ).distinct()
    every = found.groupBy("topic").agg(F.max("partition").alias("last")).select("topic", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("partition"))
    every = every.join(found.withColumn("on_disk", F.lit(True)), ["topic", "partition"], "left")
    ids = topic_ids.select(F.col("name").alias("topic"), "topic_id")
    out = every.join(ids, "topic", "left")
    return out.select("topic", F.coalesce("topic_id", names.name_uuid(F.col("topic"))).alias("topic_id"), "partition", F.coalesce("on_disk", F.lit(False)).alias("on_disk"))


def cluster_topics(records: DataFrame) -> DataFrame:
    """(name, topic_id) of topic records (name, topic_id, position) of the cluster metadata; the last record of a name counts."""
    return records.groupBy("name").agg(F.max_by("topic_id", "position").alias("topic_id"))
