"""Python data source ``log``: reads and writes directories of segment files, in batch and as a stream.

    spark.dataSource.register(LogDataSource)
    spark.read.format("log").option("path", root).load()          # also option("startOffset", 12)
    spark.readStream.format("log").option("path", root).load()
    records.repartition("topic", "partition").write.format("log").option("path", root).mode("append").save()   # also option("segmentBytes", n)

The root holds one directory per partition, ``<topic>-<number>``, each with segment files named by their base
offset. It must be a folder that all executors see.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import pickle
import re
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import codec

#: Entry of a segment's index: the offset of a batch and its position in the segment.
INDEX = struct.Struct(">ii")
#: Rows that a writing task holds before it spills them to its disk.
SPILL_ROWS = 100_000
SCHEMA = "topic string, partition int, batch_offset long, record_index int, timestamp_ms long, key binary, value binary"
_DIR = re.compile(r"^(.+)-([0-9]+)$")
_SEGMENT = re.compile(r"^[0-9]{20}\.log$")


def partition_dirs(root: str) -> list[tuple[str, int, str]]:
    """(topic, partition, path) below a root, in order; broker directories and internal topics are left out."""
    names = sorted(os.listdir(root)) if os.path.isdir(root) else []
    found = [(m[1], int(m[2]), os.path.join(root, n)) for n in names if (m := _DIR.match(n)) and not n.startswith(("broker-", "__"))]
    return [x for x in found if os.path.isdir(x[2])]


def segment_bases(path: str) -> list[int]:
    """Base offsets of the segments in a directory, in order; a missing directory has none."""
    return sorted(int(n[:20]) for n in os.listdir(path) if _SEGMENT.match(n)) if os.path.isdir(path) else []


def segment_path(path: str, base: int) -> str:
    return os.path.join(path, f"{base:020d}.log")


def read_from(file: str, start: int = 0, size: int = -1) -> bytes:
    """So many bytes of a file from a position on, or all to its end; a missing one is empty."""
    if not os.path.exists(file):
        return b""
    with open(file, "rb") as f:
        f.seek(start)
        return f.read(size)


def batches_of(file: str, start: int = 0) -> Iterator[tuple[int, codec.Batch]]:
    """(position, batch) of a segment file from a position on, one batch in memory at a time."""
    if not os.path.exists(file):
        return
    with open(file, "rb") as f:
        while True:
            f.seek(start)
            hop = f.read(codec.HOP.size)
            if len(hop) < codec.HOP.size:
                return
            length = codec.HOP.unpack(hop)[1]
            batch = codec.decode_batch(hop + f.read(max(length, codec.HEADER.size)))
            if batch is None:
                return
            yield start, batch
            if length <= 0:
                return
            start += codec.HOP.size + length


def index_path(path: str, base: int) -> str:
    return os.path.join(path, f"{base:020d}.index")


def index_position(file: str, target: int) -> int:
    """Byte position in a segment from which to read for an offset: that of the index's last entry at or before it, else 0."""
    if not os.path.exists(file):
        return 0
    low, high, found = 0, os.path.getsize(file) // INDEX.size, 0
    with open(file, "rb") as f:
        while low < high:
            middle = (low + high) // 2
            f.seek(middle * INDEX.size)
            offset, position = INDEX.unpack(f.read(INDEX.size))
            low, high, found = (middle + 1, high, position) if offset <= target else (low, middle, found)
    return found


def count_from(file: str, at: int = 0) -> tuple[int, int, int]:
    """(whole batches, batches cut at the end, position after the whole ones) from a position on, hopping from header to header."""
    n, size = 0, os.path.getsize(file)
    with open(file, "rb") as f:
        while at + codec.HOP.size <= size:
            f.seek(at)
            length = codec.HOP.unpack(f.read(codec.HOP.size))[1]
            if length < 0 or at + codec.HOP.size + length > size:
                return n, 1, at
            n += 1
            at += codec.HOP.size + length
    return n, 0, at


@dataclass
class Segment(InputPartition):
    topic: str
    partition: int
    file: str
    first: int
    last: int | None = None

    def rows(self) -> Iterator[tuple]:
        for _, b in batches_of(self.file, index_position(f"{self.file[:-4]}.index", self.first)):
            if self.last is not None and b.base_offset >= self.last:
                return
            if b.base_offset >= self.first:
                for i, r in enumerate(b.records):
                    yield self.topic, self.partition, b.base_offset, i, b.base_timestamp + r.timestamp_delta, r.key, r.value


def _segments(root: str, first: dict[str, int], last: dict[str, int] | None) -> list[Segment]:
    """The segments that hold offsets from ``first`` up to ``last``, pruned by the bases in their names."""
    out = []
    for topic, partition, path in partition_dirs(root):
        key, bases = f"{topic}-{partition}", segment_bases(path)
        begin, end = first.get(key, 0), None if last is None else last.get(key, 0)
        for base, after in zip(bases, [*bases[1:], None], strict=True):
            if (after is None or after > begin) and (end is None or base < end):
                out.append(Segment(topic, partition, segment_path(path, base), begin, end))
    return out


def _ends(root: str, known: dict[str, tuple[int, int]] | None = None) -> dict[str, int]:
    """Next offset of each partition: the last segment's base and its number of batches.

    ``known`` keeps (batches, position) of files between calls, so that only what is new is counted.
    """
    ends = {}
    for topic, partition, path in partition_dirs(root):
        if bases := segment_bases(path):
            file = segment_path(path, bases[-1])
            before, at = (known or {}).get(file, (0, 0))
            whole, cut, after = count_from(file, at)
            if known is not None:
                known[file] = (before + whole, after)
            ends[f"{topic}-{partition}"] = bases[-1] + before + whole + cut
    return ends


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.start = options["path"], int(options.get("startoffset", 0))

    def partitions(self) -> list[Segment]:
        dirs = {f"{t}-{p}": self.start for t, p, _ in partition_dirs(self.root)}
        return _segments(self.root, dirs, None)

    def read(self, partition: Segment) -> Iterator[tuple]:
        yield from partition.rows()


class LogStreamReader(DataSourceStreamReader):
    """Offsets are the next offsets of all partitions; a micro-batch holds what lies between two of them."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.known = options["path"], {}

    def initialOffset(self) -> dict:
        return {"next": "{}"}

    def latestOffset(self) -> dict:
        return {"next": json.dumps(_ends(self.root, self.known), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return _segments(self.root, json.loads(start["next"]), json.loads(end["next"]))

    def read(self, partition: Segment) -> Iterator[tuple]:
        yield from partition.rows()

    def commit(self, end: dict) -> None:
        """Nothing is deleted."""


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Sorted:
    """Rows in order of (topic, partition, batch_offset, record_index), spilled to the task's own disk when they are many."""

    def __init__(self, limit: int = SPILL_ROWS) -> None:
        self.limit, self.rows, self.runs = limit, [], []

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.limit:
            self.rows.sort(key=_place)
            run = tempfile.TemporaryFile()
            for r in self.rows:
                pickle.dump(r, run)
            run.seek(0)
            self.runs.append(run)
            self.rows = []

    def __iter__(self) -> Iterator[tuple]:
        def read(run) -> Iterator[tuple]:
            with run:
                while True:
                    try:
                        yield pickle.load(run)
                    except EOFError:
                        return

        self.rows.sort(key=_place)
        return heapq.merge(*map(read, self.runs), self.rows, key=_place)


def _place(r: tuple) -> tuple:
    return r[:4]


class LogWriter(DataSourceWriter):
    """Appends batches (topic, partition, batch_offset, ...) behind the log's end, in new segments published on commit.

    Rows of one batch_offset form a batch; batches get the offsets that follow the end, in the order of batch_offset, and with
    ``overwrite`` those from 0 on. With ``keepOffsets`` they keep the offsets they have, as a replica's do: batches that the log has are
    passed over, and one that leaves a gap is refused. A segment that has reached ``segmentBytes`` is followed by another one. All rows of a
    partition must be in one task; if they are not, or if somebody else has appended meanwhile, the write fails and
    leaves the log as it was. Topic, partition and batch_offset must not be null.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("segmentbytes", 2**30))
        self.keep = options.get("keepoffsets", "false").lower() == "true"
        self.ends = {} if overwrite else _ends(self.root)

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        attempt, rows = TaskContext.get().taskAttemptId(), _Sorted()
        for r in iterator:
            if r["topic"] is None or r["partition"] is None or r["batch_offset"] is None:
                raise ValueError("topic, partition and batch_offset must not be null")
            rows.add((r["topic"], r["partition"], r["batch_offset"], r["record_index"] or 0, r["timestamp_ms"] or 0, _raw(r["key"]), _raw(r["value"])))
        files = []
        for (topic, partition), log in itertools.groupby(rows, key=lambda r: r[:2]):
            folder, offset, size = os.path.join(self.root, f"{topic}-{partition}"), self.ends.get(f"{topic}-{partition}", 0), 0
            out = index = None
            os.makedirs(folder, exist_ok=True)
            try:
                for own, group in itertools.groupby(log, key=lambda r: r[2]):
                    if self.keep and own < offset:
                        continue
                    if self.keep and own > offset:
                        raise ValueError(f"{topic}-{partition} ends at {offset}; a batch at {own} would leave a gap")
                    if out is None or size >= self.limit:
                        _close(out, index)
                        files += [(f"{final}.{attempt}.part", final) for final in (index_path(folder, offset), segment_path(folder, offset))]
                        index, out, size = *(open(part, "wb") for part, _ in files[-2:]), 0
                    if max(offset, size) < 2**31:
                        index.write(INDEX.pack(offset, size))
                    group = list(group)
                    size += out.write(codec.encode_batch([codec.Record(r[6], r[5], r[4] - group[0][4], i) for i, r in enumerate(group)], offset, group[0][4]))
                    offset += 1
            finally:
                _close(out, index)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        new = [f for m in messages if m for f in m.files]
        finals = [final for _, final in new]
        if len(set(finals)) < len(finals):
            raise ValueError("rows of one partition were in several tasks: repartition by topic and partition")
        if not self.overwrite:
            now = _ends(self.root)
            if any(now.get(k, 0) != self.ends.get(k, 0) for k in {os.path.basename(os.path.dirname(f)) for f in finals}) or any(map(os.path.exists, finals)):
                raise RuntimeError("the log has grown since the write began")
        else:
            for _, _, path in partition_dirs(self.root):
                for file in (f(path, base) for base in segment_bases(path) for f in (segment_path, index_path)):
                    if os.path.exists(file):
                        os.remove(file)
        for part, final in new:
            os.link(part, final)  # unlike a rename it never replaces a file
            os.remove(part)

    def abort(self, messages: list[Written | None]) -> None:
        for part, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(part):
                os.remove(part)


def _close(*files: BinaryIO | None) -> None:
    """Closes files once their bytes are on disk."""
    for file in files:
        if file:
            file.flush()
            os.fsync(file.fileno())
            file.close()


def _raw(value: object) -> bytes | None:
    return None if value is None else bytes(value)


class LogDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(dict(self.options), overwrite)
