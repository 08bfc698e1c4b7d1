"""Record batches in columns: encoding, decoding, and explosion into records. Arrow batches, no row-wise UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec

RECORD = (
    "batch_offset long, record_index int, position long, leader_epoch int, timestamp_ms long, producer_id long, attributes int, key binary, value binary"
)


def _append(df: DataFrame, column: str, kind: T.DataType, arrow: pa.DataType, f: Callable[[object], object], source: str) -> DataFrame:
    """``df`` with a column made of another one."""
    place = df.columns.index(source)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = pa.array([None if x is None else f(x) for x in part.column(place).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, column])

    return df.mapInArrow(task, T.StructType([*df.schema.fields, T.StructField(column, kind)]))


def encode_values(df: DataFrame, values: str, column: str) -> DataFrame:
    """Adds the record batch of a column of values (array of binary)."""
    return _append(df, column, T.BinaryType(), pa.binary(), lambda vs: codec.encode_batch([codec.Record(v, offset_delta=i) for i, v in enumerate(vs)]), values)


def decode_values(df: DataFrame, data: str, column: str) -> DataFrame:
    """Adds the values of the first record batch in a binary column; empty ones are skipped, a cut tail is dropped."""
    return _append(df, column, T.ArrayType(T.BinaryType()), pa.list_(pa.binary()), lambda d: codec.record_values(bytes(d)), data)


def rows_of(data: bytes, start: int = 0) -> Iterator[tuple]:
    """Rows of RECORD of every record in a segment from a byte position on."""
    for place, b in codec.batches(data, start):
        for i, r in enumerate(b.records):
            yield b.base_offset, i, place, b.leader_epoch, b.base_timestamp + r.timestamp_delta, b.producer_id, b.attributes, r.key, r.value


def segment_records(files: DataFrame) -> DataFrame:
    """path and the RECORD columns of segment files (path, content), as ``spark.read.format('binaryFile')`` gives them."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([("path", pa.string()), *((n, kinds[k]) for n, k in (x.split(" ") for x in RECORD.split(", ")))])

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows = [(path, *r) for r in rows_of(content or b"")]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(task, f"path string, {RECORD}")


def count_batches(files: DataFrame) -> DataFrame:
    """path, n_batches of segment files (path, content), by headers alone."""
    return _append(files.select("path", "content"), "n_batches", T.LongType(), pa.int64(), lambda d: codec.count_batches(bytes(d)), "content").drop("content")


def recovered_offsets(files: DataFrame) -> DataFrame:
    """(directory, next_offset) of segment files: the last segment's base and the number of its batches."""
    from ..functions.names import segment_base

    parts = F.regexp_extract("path", r"([^/]+)/([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/([^/]+)$", 2)
    counted = count_batches(files).select(parts[0].alias("directory"), segment_base(parts[1]).alias("base"), "n_batches").filter("base IS NOT NULL")
    return counted.groupBy("directory").agg(F.max(F.struct("base", "n_batches")).alias("last")).select("directory", (F.col("last.base") + F.col("last.n_batches")).alias("next_offset"))


def topic_records(files: DataFrame) -> DataFrame:
    """(name, topic_id, position) of the topic records in cluster-metadata segments (path, content)."""
    values = segment_records(files).select("path", "position", "record_index", "value")
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("topic_id", T.StringType())])

    def read(v: object) -> dict | None:
        found = codec.topic_record(bytes(v))
        return {"name": found[0], "topic_id": found[1]} if found else None

    out = _append(values, "topic", kind, pa.struct([("name", pa.string()), ("topic_id", pa.string())]), read, "value").filter("topic IS NOT NULL")
    return out.select("topic.name", "topic.topic_id", F.struct("path", "position", "record_index").alias("position"))
