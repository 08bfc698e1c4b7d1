"""Small text sources: the offset log, the properties file, and the seed topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "group string, topic string, partition int, offset long"


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the appends below a path, on any file system that Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n) for n in names if n.isdigit())


def read_offset_log(spark: SparkSession, path: str) -> DataFrame:
    """(group, topic, partition, offset, seq) of a log of committed offsets, one JSON object a line; bad lines are skipped.

    seq is the place in the log: append by append, row by row. Lines of files that stand beside the appends come first, by
    file name and line.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.withColumn("c", F.from_json("value", f"{COMMIT}, place long", {"mode": "PERMISSIVE"}))
    parsed = parsed.filter("c.group IS NOT NULL AND c.topic IS NOT NULL AND c.partition IS NOT NULL AND c.offset IS NOT NULL")
    number = F.expr("try_cast(regexp_extract(file, '/([0-9]{20})/[^/]*$', 1) AS bigint)")
    seq = F.struct(F.coalesce(number, F.lit(-1)).alias("append"), F.coalesce("c.place", F.lit(-1)).alias("place"), "file", "line")
    return parsed.select("c.group", "c.topic", "c.partition", "c.offset", seq.alias("seq"))


def append_offset_log(commits: DataFrame, path: str) -> None:
    """Appends (group, topic, partition, offset) to an offset log, in a folder of its own, numbered after the last one.

    Rows count in the order of ``commits``. Of two writers that append at the same time the second one fails.
    """
    number = max(_folders(commits.sparkSession, path), default=-1) + 1
    rows = commits.select("group", "topic", "partition", "offset", F.monotonically_increasing_id().alias("place"))
    rows.write.mode("error").json(f"{path}/{number:020d}")


def read_properties(text: str) -> dict[str, str]:
    """Keys and values of a properties file; blank lines and comments are skipped."""
    pairs = (x.split("=", 1) for x in map(str.strip, text.splitlines()) if x and not x.startswith(("#", "!")) and "=" in x)
    return {k.strip(): v.strip() for k, v in pairs}


def log_dirs(text: str) -> str | None:
    return read_properties(text).get("log.dirs")


def seed_topics(spark: SparkSession) -> DataFrame:
    """Records (topic, partition, batch_offset, record_index, timestamp_ms, key, value) of two demo topics.

    ``orders`` has three partitions of five records, ``events`` two of three, one record per batch.
    """
    def topic(name: str, partitions: int, each: int, key: str, value: Column) -> DataFrame:
        rows = spark.range(partitions * each).withColumns({"partition": F.expr(f"int(id div {each})"), "batch_offset": F.expr(f"id % {each}")})
        return rows.select(F.lit(name).alias("topic"), "partition", "batch_offset", F.format_string(f"{key}%03d", "id").alias("key"), F.to_json(value).alias("value"))

    pieces = F.struct((F.col("id") % 4 + 1).alias("pieces"), (F.col("id") * 5 + 10).alias("cents"), F.format_string("sku-%d", "id").alias("sku"))
    clicks = F.struct(F.format_string("/help/%d", "id").alias("path"), (F.col("id") * 250).alias("after_ms"))
    both = topic("orders", 3, 5, "o", pieces).unionByName(topic("events", 2, 3, "e", clicks))
    return both.select("topic", "partition", "batch_offset", F.lit(0).alias("record_index"), F.lit(0).cast("long").alias("timestamp_ms"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
