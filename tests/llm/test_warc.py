import gzip
import hashlib
import time
import zlib
from html.parser import HTMLParser

from loomlog.llm import queries, warc


def test_records_round_trip():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody WARC/1.1 \r\n\r\n inside"
    one = warc.serialise([("WARC-Type", "response"), ("X", None), ("Y", "a\r\nb")], block)
    two = warc.serialise([("WARC-Type", "metadata")], b"")
    for data in (one + two, gzip.compress(one) + gzip.compress(two)):
        found = list(warc.parse(data))
        assert [b for _, b in found] == [block, b""]
        assert found[0][0]["y"] == "a b" and "x" not in found[0][0]
    assert len(list(warc.parse(one + two[:-6]))) == 1
    assert warc.http_parts(block) == (200, "A: b", b"body WARC/1.1 \r\n\r\n inside")
    assert warc.http_parts(b"no headers") == (None, "", b"no headers")


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_text_equals_html_parser():
    source = "<!DOCTYPE html><html lang='en'><head><title>T &amp; t</title><style>p{}</style><script>var a='</p>';</script></head><body><!-- x > y --><p>One <b>two</b><br>three</p><ul><li><a href=\"/q?a=1&amp;b=2\">four</a></ul>5 &lt; 6</body>"
    p = Plain()
    p.feed(source)
    assert warc.to_text(source).split() == p.words
    assert warc.described(source) == [("title", "T & t"), ("language", "en"), ("outlink", "/q?a=1&b=2")]
    assert warc.to_text("<script>never closed <p>x") == "" and warc.to_text("a <!-- b") == "a" and warc.to_text("1 < 2 > 1") == "1 < 2 > 1"


def test_hostile_and_long_pages_are_read_in_linear_time():
    began = time.monotonic()
    for piece in ("<script", "<p", "<a", "<a ", "<p ", "<title>", "<!--", "</", "<a href=", '<a href="', "<p class='", "<html ", "= ", "<script ", "<a x = "):
        source = piece * 60_000
        assert isinstance(warc.to_text(source), str) and isinstance(warc.described(source), list)
    assert warc.to_text("<p>word</p>" * 50_000) == "\n".join(["word"] * 50_000)
    assert time.monotonic() - began < 30


def test_quotes_hold_the_ends_of_tags():
    assert warc.to_text('a<img alt="x > y">b <i title=\'>\'>c</i>') == "ab c"
    assert warc.described("<a class='>' HREF = '/x'>1</a><a name=y>2</a><a href=z>3</a>") == [("outlink", "/x"), ("outlink", "z")]
    assert warc.to_text("it's <b>it's</b> = \"so\"") == "it's it's = \"so\""


def test_encodings_are_undone():
    text = "<p>né</p>".encode()
    chunked = b"".join(b"%x;e=1\r\n%s\r\n" % (len(x), x) for x in (text[:4], text[4:])) + b"0\r\n\r\n"
    deflate = zlib.compressobj(wbits=-15)
    raw = deflate.compress(text) + deflate.flush()
    for head, body in (
        ("Content-Encoding: gzip", gzip.compress(text)), ("content-encoding: deflate", zlib.compress(text)), ("Content-Encoding: deflate", raw), ("Transfer-Encoding: chunked", chunked),
        ("Content-Encoding: br", text), ("Content-Encoding: gzip", text), ("Transfer-Encoding: chunked", text), ("", text),
    ):
        r = warc.response_record("1", "http://a/", "") | {"payload": body, "http_headers": head}
        assert [x["content"] for x in warc.derivatives(r) if x["record_type"] == "conversion"] == ["né"]


def test_files_are_read_record_by_record(monkeypatch):
    blocks = [bytes([i]) * (i * 37 % 4001) + b"WARC/1.1\r\n\r\n" for i in range(120)]
    records = [warc.serialise([("WARC-Type", "resource"), ("N", str(i))], b) for i, b in enumerate(blocks)]
    for piece in (7, 1000, 2**20):
        monkeypatch.setattr(warc, "PIECE", piece)
        for data in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
            assert [(h["n"], b) for h, b in warc.parse(data)] == [(str(i), b) for i, b in enumerate(blocks)]
    assert len(list(warc.parse(gzip.compress(b"".join(records))[:-30]))) < 120


def test_derivatives_link_to_their_response(spark):
    rows = [(1, "http://a/", "<p>x</p>", "z"), (1, "http://a/", "<p>x</p>", "z"), (2, None, None, "z"), (None, "u", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    found = warc.responses(pages)
    sources = {r.record_id: r for r in found.collect()}
    out = warc.derive(found, "<urn:uuid:info>").collect()
    assert len(out) == 8 and {r.record_type for r in out} == {"metadata", "conversion"}
    for r in out:
        s = sources[r.refers_to]
        assert (r.source_payload_digest, r.source_block_digest, r.source_headers) == (s.payload_digest, s.block_digest, s.http_headers)
        ((head, block),) = warc.parse(r.record)
        assert head["warc-refers-to"] == r.refers_to and head["warc-block-digest"] == warc.digest(block) == r.block_digest
        assert block.decode() == r.content and len(block) == r.content_length and head.get("warc-target-uri") == s.target_uri
    assert [r.content for r in out if r.record_type == "conversion" and r.page_id == 1] == ["x", "x"]
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []


def test_read_warc_gives_what_was_written(spark, tmp_path):
    r = warc.response_record("1", "http://a/", "<p>é</p>")
    block = b"HTTP/1.1 200 OK\r\n" + r["http_headers"].replace("\n", "\r\n").encode() + b"\r\n\r\n" + r["payload"]
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]), ("WARC-Payload-Digest", r["payload_digest"])]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(warc.serialise([("WARC-Type", "warcinfo")], b"x")) + gzip.compress(warc.serialise(headers, block)))
    (got,) = warc.read_warc(spark, str(tmp_path)).collect()
    assert {k: (bytes(v) if isinstance(v, bytearray) else v) for k, v in got.asDict().items() if k != "page_id"} == r


def test_query_tells_length_and_digest_of_each_record(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.example/", "<title>T</title><p>one"), (2, "http://b.example/", None)], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    records = {r.record_id: r.record for r in warc.derive(warc.responses(df)).collect()}
    rows = queries.op3_warc(spark, str(tmp_path)).collect()
    assert {r.record_id: (r.record_length, r.record_sha256) for r in rows} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in records.items()}
    assert len(rows) == len(records) > 0
