"""Names of segments, partition directories and topics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DLQ_SUFFIX = ".dlq"
SEGMENT_NAME = r"^[0-9]{20}\.log$"


def segment_file(base_offset: Column) -> Column:
    """File name of the segment that starts at an offset: twenty digits and the suffix."""
    return F.concat(F.lpad(base_offset.cast("string"), 20, "0"), F.lit(".log"))


def index_file(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\.log$", ".index")


def segment_base(name: Column) -> Column:
    """Base offset in a segment's file name; null for other files."""
    return F.when(name.rlike(SEGMENT_NAME), F.substring(name, 1, 20).try_cast("bigint"))


def directory_topic(name: Column) -> Column:
    """Topic of a partition directory: what precedes the last hyphen, if a number follows it."""
    return F.when(name.rlike(r"^.+-[0-9]+$"), F.regexp_extract(name, r"^(.+)-([0-9]+)$", 1))


def directory_partition(name: Column) -> Column:
    return F.when(name.rlike(r"^.+-[0-9]+$"), F.regexp_extract(name, r"^(.+)-([0-9]+)$", 2).try_cast("int"))


def is_topic_directory(name: Column) -> Column:
    """Whether recovery loads a directory: broker directories and internal topics are left out."""
    return directory_partition(name).isNotNull() & ~name.startswith("broker-") & ~name.startswith("__")


def dlq_topic(topic: Column) -> Column:
    return F.concat(topic, F.lit(DLQ_SUFFIX))


def name_uuid(name: Column) -> Column:
    """A topic id that depends on the name alone, in the canonical form of a UUID."""
    h = F.md5(name.cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
