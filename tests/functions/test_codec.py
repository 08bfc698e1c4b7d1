import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomlog.functions import codec


@pytest.mark.parametrize(("n", "raw"), [(0, "00"), (1, "01"), (127, "7f"), (128, "8001"), (300, "ac02")])
def test_unsigned_varint(n, raw):
    assert codec.write_uvarint(n).hex() == raw and codec.Reader(bytes.fromhex(raw)).uvarint() == n


@pytest.mark.parametrize(("s", "first"), [("", 1), ("hi", 3), ("hello", 6), ("topic-name-0", 13), (None, 0)])
def test_compact_string(s, first):
    raw = codec.Writer().compact_string(s).done()
    assert raw[0] == first and codec.Reader(raw).compact_string() == s


@given(st.integers(-(2**63), 2**63 - 1))
def test_zig_zag_round_trip(n):
    assert codec.Reader(codec.write_varint(n)).varint() == n


def test_values_of_a_batch():
    one = codec.encode_batch([codec.Record(b'{"msg":"hello"}')])
    assert codec.record_values(one) == [b'{"msg":"hello"}']
    assert codec.record_values(b"ab") == codec.record_values(b"") == codec.record_values(bytes(61)) == []
    three = codec.encode_batch([codec.Record(x) for x in (b"aaa", b"bb", b"", None, b"c")])
    assert codec.record_values(three) == [b"aaa", b"bb", b"c"]
    assert codec.record_values(three[:-4]) == [b"aaa", b"bb"]
    assert codec.record_values(three + one) == [b"aaa", b"bb", b"c"]


def test_broken_records_are_skipped():
    good = [codec.encode_record(codec.Record(x)) for x in (b"one", b"two", b"three")]
    header = codec.HEADER.pack(0, 49, 0, 2, 0, 0, 2, 0, 0, -1, -1, -1, 3)
    cut = b"\0\0\0\x01\x06tw"  # its value is longer than the record
    bad = codec.write_varint(len(cut)) + cut
    assert codec.record_values(header + good[0] + bad + good[2]) == [b"one", b"three"]
    body = good[1][1:-1]  # without the number of headers
    assert codec.record_values(header + good[0] + codec.write_varint(len(body)) + body + good[2]) == [b"one", b"two", b"three"]
    for length in (-1, 0, 7, 10**9):
        wrong = codec.HEADER.pack(0, length, 0, 2, 0, 0, 2, 0, 0, -1, -1, -1, 3)
        assert codec.record_values(wrong + b"".join(good)) == [b"one", b"two", b"three"]
    assert codec.record_values(header + good[0] + b"\0" + good[2]) == [b"one"]  # a record without length ends the batch


records = st.lists(st.builds(codec.Record, st.none() | st.binary(max_size=40), st.none() | st.binary(max_size=9), st.integers(-9, 2**40), st.integers(0, 99), st.just(0), st.just((("h", b"v"), ("n", None)))), max_size=6)


@given(st.lists(records, max_size=4))
def test_segments_round_trip(groups):
    data = b"".join(codec.encode_batch(g, i, leader_epoch=3) for i, g in enumerate(groups))
    found = [b for _, b in codec.batches(data)]
    assert [list(b.records) for b in found] == groups and [b.base_offset for b in found] == list(range(len(groups)))
    assert codec.count_batches(data) == len(groups)
    if groups and groups[-1]:
        assert codec.count_batches(data[:-1]) == len(groups)


def test_group_metadata_round_trip():
    assert codec.decode_member_metadata(codec.encode_member_metadata(1, ["a", "b"], b"x")) == (1, ["a", "b"], b"x")
    assert codec.decode_assignment(codec.encode_assignment(0, {"a": [0, 2], "b": []})) == (0, {"a": [0, 2], "b": []}, None)
    topic = str(uuid.uuid4())
    assert codec.topic_record(codec.encode_topic_record("orders", topic)) == ("orders", topic)
    assert codec.topic_record(b"\1\3\0\2a") is None and codec.topic_record(b"") is None


def test_missing_bytes_and_long_varints_are_errors():
    for read in (codec.Reader(b"\0").int32, codec.Reader(b"\0\5ab").string, codec.Reader(b"\x80" * 11).uvarint):
        with pytest.raises(codec.Malformed):
            read()
    assert codec.Reader(b"\xff\xff").string() is None and codec.Reader(b"\0").compact_bytes() is None
    assert codec.Reader(b"\xff\xff\xff\xff").bytes() is None
