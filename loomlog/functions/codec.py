"""Binary codecs of the log: primitives, record batches, group metadata. Pure Python, used inside tasks."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: base offset, length, leader epoch, magic, crc, attributes, last offset delta, base and max timestamp, producer id,
#: producer epoch, base sequence, number of records
HEADER = struct.Struct(">qiibIhiqqqhii")
#: base offset and length, which suffice to hop from batch to batch
HOP = struct.Struct(">qi")
MAX_VARINT_BYTES = 10


class Malformed(ValueError):
    """The bytes do not hold what was asked for."""


def write_uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def write_varint(n: int) -> bytes:
    """Zig-zag form of a signed 64-bit number."""
    return write_uvarint((n << 1 ^ n >> 63) & 2**64 - 1)


class Reader:
    """Reads primitives one after another; raises Malformed where bytes are missing."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Malformed(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def _number(self, code: str) -> int:
        return struct.unpack(f">{code}", self.take(struct.calcsize(code)))[0]

    def int8(self) -> int:
        return self._number("b")

    def int16(self) -> int:
        return self._number("h")

    def int32(self) -> int:
        return self._number("i")

    def int64(self) -> int:
        return self._number("q")

    def uvarint(self) -> int:
        value = 0
        for k in range(MAX_VARINT_BYTES):
            b = self.take(1)[0]
            value |= (b & 0x7F) << 7 * k
            if b < 0x80:
                return value
        raise Malformed("varint of more than ten bytes")

    def varint(self) -> int:
        u = self.uvarint()
        return u >> 1 ^ -(u & 1)

    def string(self) -> str | None:
        n = self.int16()
        return None if n < 0 else self.take(n).decode("utf-8", "replace")

    def compact_string(self) -> str | None:
        n = self.uvarint()
        return None if n == 0 else self.take(n - 1).decode("utf-8", "replace")

    def bytes(self) -> bytes | None:
        n = self.int32()
        return None if n < 0 else self.take(n)

    def compact_bytes(self) -> bytes | None:
        n = self.uvarint()
        return None if n == 0 else self.take(n - 1)

    def array(self, item: Callable[[], object]) -> list:
        return [item() for _ in range(max(0, self.int32()))]

    def compact_array(self, item: Callable[[], object]) -> list:
        return [item() for _ in range(max(0, self.uvarint() - 1))]

    def uuid(self) -> str:
        return str(uuid.UUID(bytes=self.take(16)))

    def tags(self) -> None:
        """Skips a buffer of tagged fields."""
        for _ in range(self.uvarint()):
            self.uvarint()
            self.take(self.uvarint())


class Writer:
    """The counterpart of Reader."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def raw(self, data: bytes) -> Writer:
        self.parts.append(data)
        return self

    def number(self, code: str, n: int) -> Writer:
        return self.raw(struct.pack(f">{code}", n))

    def string(self, s: str | None) -> Writer:
        return self.number("h", -1) if s is None else self.number("h", len(s.encode())).raw(s.encode())

    def compact_string(self, s: str | None) -> Writer:
        return self.raw(b"\0") if s is None else self.raw(write_uvarint(len(s.encode()) + 1)).raw(s.encode())

    def bytes(self, b: bytes | None) -> Writer:
        return self.number("i", -1) if b is None else self.number("i", len(b)).raw(b)

    def compact_bytes(self, b: bytes | None) -> Writer:
        return self.raw(b"\0") if b is None else self.raw(write_uvarint(len(b) + 1)).raw(b)

    def uuid(self, u: str) -> Writer:
        return self.raw(uuid.UUID(u).bytes)

    def tags(self) -> Writer:
        return self.raw(b"\0")

    def done(self) -> bytes:
        return b"".join(self.parts)


@dataclass(frozen=True)
class Record:
    value: bytes | None
    key: bytes | None = None
    timestamp_delta: int = 0
    offset_delta: int = 0
    attributes: int = 0
    headers: tuple[tuple[str, bytes | None], ...] = ()


@dataclass(frozen=True)
class Batch:
    base_offset: int
    length: int
    leader_epoch: int
    magic: int
    crc: int
    attributes: int
    last_offset_delta: int
    base_timestamp: int
    max_timestamp: int
    producer_id: int
    producer_epoch: int
    base_sequence: int
    records_count: int
    records: tuple[Record, ...] = field(default=())


def encode_record(r: Record) -> bytes:
    body = bytearray(struct.pack("b", r.attributes) + write_varint(r.timestamp_delta) + write_varint(r.offset_delta))
    for part in (r.key, r.value):
        body += write_varint(-1) if part is None else write_varint(len(part)) + part
    body += write_varint(len(r.headers))
    for k, v in r.headers:
        body += write_varint(len(k.encode())) + k.encode() + (write_varint(-1) if v is None else write_varint(len(v)) + v)
    return write_varint(len(body)) + bytes(body)


def encode_batch(records: list[Record], base_offset: int = 0, base_timestamp: int = 0, leader_epoch: int = 0, with_crc: bool = False) -> bytes:
    """A record batch (magic 2). The checksum is 0 unless asked for, as no reader inspects it."""
    body = b"".join(map(encode_record, records))
    last = max(len(records) - 1, 0)
    newest = base_timestamp + max((r.timestamp_delta for r in records), default=0)
    crc = zlib.crc32(body) if with_crc else 0
    head = (base_offset, HEADER.size - HOP.size + len(body), leader_epoch, 2, crc, 0, last, base_timestamp, newest, -1, -1, -1, len(records))
    return HEADER.pack(*head) + body


def _record(body: Reader) -> Record:
    """A record from its body; headers that cannot be read are left out."""
    attributes, timestamp, offset = body.int8(), body.varint(), body.varint()
    key, value = ((None if (n := body.varint()) < 0 else body.take(n)) for _ in range(2))
    try:
        headers = tuple((body.take(body.varint()).decode("utf-8", "replace"), None if (n := body.varint()) < 0 else body.take(n)) for _ in range(body.varint()))
    except Malformed:
        headers = ()
    return Record(value, key, timestamp, offset, attributes, headers)


def _records(r: Reader, count: int) -> Iterator[Record]:
    """Up to ``count`` records. One whose fields do not fit its size is skipped; one without a size, or cut, ends them."""
    for _ in range(count):
        try:
            size = r.varint()
            if size <= 0:
                return
            body = Reader(r.take(size))
        except Malformed:
            return
        try:
            yield _record(body)
        except Malformed:
            continue


def decode_batch(data: bytes, at: int = 0) -> Batch | None:
    """The batch at a position with the records that can be read; None where no whole header is left."""
    if at + HEADER.size > len(data):
        return None
    head = HEADER.unpack_from(data, at)
    end = min(len(data), at + HOP.size + max(head[1], 0))
    return Batch(*head, tuple(_records(Reader(data[:end], at + HEADER.size), head[-1])))


def record_values(data: bytes) -> list[bytes]:
    """Values of the first batch in ``data``, whatever length its header gives; nulls and empty values are skipped."""
    if len(data) < HEADER.size:
        return []
    return [r.value for r in _records(Reader(data, HEADER.size), HEADER.unpack_from(data)[-1]) if r.value]


def batches(data: bytes, at: int = 0) -> Iterator[tuple[int, Batch]]:
    """(position, batch) of all batches of a segment."""
    while (batch := decode_batch(data, at)) is not None:
        yield at, batch
        if batch.length <= 0:
            return
        at += HOP.size + batch.length


def count_batches(data: bytes) -> int:
    """Number of batches by their headers alone; one whose body is cut still counts."""
    at = n = 0
    while at + HOP.size <= len(data):
        _, length = HOP.unpack_from(data, at)
        n += 1
        if length < 0:
            break
        at += HOP.size + length
    return n


def topic_record(value: bytes) -> tuple[str, str] | None:
    """(name, id) of a topic record of the cluster metadata, None for records of other types."""
    try:
        r = Reader(value)
        r.int8()
        if r.int8() != 2:
            return None
        r.int8()
        name, topic_id = r.compact_string(), r.uuid()
    except Malformed:
        return None
    return (name, topic_id) if name else None


def encode_topic_record(name: str, topic_id: str) -> bytes:
    return Writer().raw(b"\1\2\0").compact_string(name).uuid(topic_id).tags().done()


def encode_member_metadata(version: int, topics: list[str], user_data: bytes | None = None) -> bytes:
    w = Writer().number("h", version).number("i", len(topics))
    for t in topics:
        w.string(t)
    return w.bytes(user_data).done()


def decode_member_metadata(data: bytes) -> tuple[int, list[str], bytes | None]:
    r = Reader(data)
    return r.int16(), r.array(r.string), r.bytes()


def encode_assignment(version: int, assigned: dict[str, list[int]], user_data: bytes | None = None) -> bytes:
    w = Writer().number("h", version).number("i", len(assigned))
    for topic, partitions in assigned.items():
        w.string(topic).number("i", len(partitions))
        for p in partitions:
            w.number("i", p)
    return w.bytes(user_data).done()


def decode_assignment(data: bytes) -> tuple[int, dict[str, list[int]], bytes | None]:
    r = Reader(data)
    return r.int16(), dict(r.array(lambda: (r.string(), r.array(r.int32)))), r.bytes()
