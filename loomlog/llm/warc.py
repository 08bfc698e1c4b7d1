"""WARC derivatives: each response gives a metadata and a plain-text conversion record that refer to it.

``responses`` makes response records of a table of pages, ``read_warc`` reads them from files; ``derive``
turns either into derivative records. Identifiers are name-based, so a rerun gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits

VERSION = "WARC/1.1"
#: Bytes of a file that are inflated at a time.
PIECE = 2**20
SPACE = uuid.UUID("6f1d2c5e-0b7a-5c39-9a41-3f0e7a5d9b10")
DATE = "2024-01-01T00:00:00Z"
RESPONSE = "record_id string, target_uri string, date string, http_status int, http_headers string, payload binary, block_digest string, payload_digest string"
DERIVED = (
    "record_type string, record_id string, refers_to string, refers_to_target_uri string, refers_to_date string, warcinfo_id string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, source_block_digest string, source_headers string, content string, record binary"
)

# All tag patterns end at the text's end at the latest and never give back what they have read, so each is one linear scan.
#: Attributes up to a tag's end; quotes after an equals sign may hold it.
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)(?=[\s/>]){_ATTRS}(?:>|\Z).*?(?:</\1\s*+>|\Z)", re.S | re.I)
_BREAK = re.compile(
    rf"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?=[\s/>]){_ATTRS}(?:>|\Z)", re.I
)
_TAG = re.compile(rf"<[a-zA-Z/!?]{_ATTRS}(?:>|\Z)")
_TITLE = re.compile(rf"<title(?=[\s/>]){_ATTRS}>(.*?)(</title|\Z)", re.S | re.I)
_NAMED = re.compile(rf"<(html|a)(?=\s)({_ATTRS})(?:>|\Z)", re.I)
_ATTR = re.compile(r"""(?<![^\s/"'])(lang|href)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    """Labelled SHA-1 in base 32, as WARC headers carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(parts))}>"


def one_line(value: str) -> str:
    """A header value without line breaks and control characters."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def to_text(source: str) -> str:
    """Plain text of HTML: hidden elements and tags dropped, entities decoded, one line per block, no blank lines."""
    out = _BREAK.sub("\n", _HIDDEN.sub(" ", source))
    out = html.unescape(_TAG.sub("", out))
    lines = (_BLANK.sub(" ", x).strip() for x in out.split("\n"))
    return "\n".join(x for x in lines if x)


def described(source: str) -> list[tuple[str, str]]:
    """What the metadata record says about a page: title, language, links in order."""
    seen = _HIDDEN.sub(" ", source)
    found, lang, links = [], None, []
    if (m := _TITLE.search(seen)) and m[2]:
        found.append(("title", one_line(html.unescape(_TAG.sub("", m[1])))))
    for m in _NAMED.finditer(seen):
        wanted = "lang" if m[1].lower() == "html" else "href"
        value = next((x[2] or x[3] or x[4] or "" for x in _ATTR.finditer(m[2]) if x[1].lower() == wanted), None)
        if wanted == "href" and value is not None:
            links.append(("outlink", one_line(html.unescape(value))))
        elif wanted == "lang" and value and lang is None:
            lang = re.match("[A-Za-z-]*", value)[0].lower()
    return found + ([("language", lang)] if lang else []) + links


def decoded_body(headers: str, payload: bytes) -> bytes:
    """A payload without its transfer and content encodings; as it is where they are unknown or broken."""
    said = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (x.partition(":") for x in headers.split("\n")))
    if said.get("transfer-encoding") == "chunked":
        payload = _unchunked(payload)
    for coding in reversed([x.strip() for x in said.get("content-encoding", "").split(",") if x.strip()]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = zlib.decompress(payload, 47)
            elif coding == "deflate":
                payload = zlib.decompress(payload) if payload[:1] == b"\x78" else zlib.decompress(payload, -15)
            elif coding != "identity":
                return payload
        except zlib.error:
            return payload
    return payload


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked message; the data as they are if they are not chunked."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at, at + 1024)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data
        if size <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else data


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record; headers without a value are left out."""
    lines = [VERSION, *(f"{k}: {one_line(v)}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of a plain or gzipped file, member by member."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data) and data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            piece = view[at : at + PIECE]
            try:
                out = member.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)
            if out:
                yield out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a plain or gzipped WARC file; a cut last record is dropped.

    A gzipped file is inflated piece by piece, so only the record at hand is in memory beside it.
    """
    rest, at = b"", 0
    pieces = inflated(data)
    more = True

    def fill(wanted: int) -> bool:
        """Holds ``wanted`` bytes from ``at`` on, if there are so many."""
        nonlocal rest, at, more
        parts, held = [rest[at:] if at else rest], len(rest) - at
        while held < wanted and more:
            piece = next(pieces, None)
            more = piece is not None
            if more:
                parts.append(piece)
                held += len(piece)
        rest, at = (parts[0] if len(parts) == 1 else b"".join(parts)), 0
        return held >= wanted

    def seek(mark: bytes, start: int) -> int:
        """Place of a mark from ``at + start`` on, -1 if there is none."""
        nonlocal rest
        while (found := rest.find(mark, at + start)) < 0:
            held = len(rest) - at
            start = max(start, held - len(mark) + 1)
            if not fill(held + PIECE) and len(rest) - at <= held:
                return -1
        return found - at

    while (start := seek(b"WARC/", 0)) >= 0:
        end = seek(b"\r\n\r\n", start)
        if end < 0:
            return
        fields: dict[str, str] = {}
        for line in rest[at + start : at + end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        if len(rest) - at < end + 4 + size and not fill(end + 4 + size):
            return
        yield fields, rest[at + end + 4 : at + end + 4 + size]
        at += end + 4 + size


def http_parts(block: bytes) -> tuple[int | None, str, bytes]:
    """(status, header lines, payload) of an HTTP response block; a block without headers is all payload."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not found:
        return None, "", block
    first, _, rest = head.decode("utf-8", "replace").partition("\r\n")
    status = first.split(" ")[1] if len(first.split(" ")) > 1 else ""
    return int(status) if status.isdigit() else None, rest.replace("\r\n", "\n"), body


def response_record(page: str, url: str | None, body: str | None, date: str = DATE) -> dict:
    """A response record, as a row of RESPONSE, for a page that was fetched without its headers."""
    payload = (body or "").encode()
    head = f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
    block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + payload
    return {
        "record_id": record_id("response", page, url or "", digest(payload)), "target_uri": url, "date": date, "http_status": 200,
        "http_headers": head.replace("\r\n", "\n"), "payload": payload, "block_digest": digest(block), "payload_digest": digest(payload),
    }


def derivatives(r: dict, warcinfo: str | None = None) -> list[dict]:
    """The metadata and the conversion record of a response, as rows of DERIVED."""
    raw = decoded_body(r["http_headers"] or "", r["payload"] or b"")
    names = [m[1].decode() for m in (_CHARSET.search((r["http_headers"] or "").encode()), _CHARSET.search(raw[:2048])) if m]
    try:
        source = raw.decode(names[0] if names else "utf-8", "replace")
    except LookupError:
        source = raw.decode("utf-8", "replace")
    text = to_text(source)
    said = [("source-record-id", r["record_id"]), ("source-payload-digest", r["payload_digest"]), ("source-block-digest", r["block_digest"]), ("source-http-status", r["http_status"])]
    said += [("source-header", h) for h in (r["http_headers"] or "").split("\n") if h]
    said += described(source)
    fields = "".join(f"{k}: {one_line(str(v))}\r\n" for k, v in said if v is not None)
    out = []
    for kind, content_type, content in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text)):
        block = content.encode()
        own = record_id(kind, r["record_id"] or "", digest(block))
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["record_id"]),
            ("WARC-Refers-To-Target-URI", r["target_uri"]), ("WARC-Refers-To-Date", r["date"]), ("WARC-Warcinfo-ID", warcinfo),
            ("WARC-Block-Digest", digest(block)), ("WARC-Source-Payload-Digest", r["payload_digest"]), ("Content-Type", content_type),
        ]
        out.append({
            "record_type": kind, "record_id": own, "refers_to": r["record_id"], "refers_to_target_uri": r["target_uri"], "refers_to_date": r["date"],
            "warcinfo_id": warcinfo, "content_type": content_type, "content_length": len(block), "block_digest": digest(block),
            "source_payload_digest": r["payload_digest"], "source_block_digest": r["block_digest"], "source_headers": r["http_headers"],
            "content": content, "record": serialise(headers, block),
        })
    return out


def _arrow(schema: str, *more: pa.Field) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([*more, *(pa.field(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", ")))])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """page_id and the RESPONSE columns of every row of ``pages``; null bodies count as empty, null urls stay null."""
    arrow_limits(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [response_record(str(p), u, h, date) for p, u, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            made = pa.RecordBatch.from_pylist(rows, _arrow(RESPONSE))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], ["page_id", *made.schema.names])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(task, f"page_id {kind}, {RESPONSE}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The RESPONSE columns (and page_id, the record's place in its file) of the response records of WARC files.

    A task holds one file as it is stored and the record at hand.
    """
    arrow_limits(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows: list[dict] = []
                for i, (h, block) in enumerate(parse(data)):
                    if h.get("warc-type") != "response":
                        continue
                    status, lines, payload = http_parts(block)
                    rows.append({
                        "page_id": i, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "http_status": status,
                        "http_headers": lines, "payload": payload, "block_digest": h.get("warc-block-digest") or digest(block),
                        "payload_digest": h.get("warc-payload-digest") or digest(payload),
                    })
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, _arrow(RESPONSE, pa.field("page_id", pa.int64())))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _arrow(RESPONSE, pa.field("page_id", pa.int64())))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task, f"page_id long, {RESPONSE}")


def derive(found: DataFrame, warcinfo: str | None = None) -> DataFrame:
    """page_id and the DERIVED columns: a metadata and a conversion record for every response.

    Empty and null payloads give an empty conversion; transfer and content encodings are undone for it. Repeated responses give equal derivatives, each of
    them. Source headers and digests are carried over unchanged; other columns are ignored.
    """
    kind = found.schema["page_id"].dataType.simpleString()
    names = [x.split(" ")[0] for x in RESPONSE.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for r in batch.select(names).to_pylist() for x in derivatives(r, warcinfo)]
            made = pa.RecordBatch.from_pylist(rows, _arrow(DERIVED))
            place = pa.array([i for i in range(batch.num_rows) for _ in range(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), *made.columns], ["page_id", *made.schema.names])

    return found.select("page_id", *names).mapInArrow(task, f"page_id {kind}, {DERIVED}")
