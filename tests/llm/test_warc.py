"""Header lines of a response that repeat are all in its metadata record."""

import gzip
import json
import zlib

from lateweave.llm import warc


def test_repeated_headers(spark):
    message = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nVary: Accept\r\n"
               b"set-cookie: b=2\r\n\r\n<p>x</p>")
    responses = spark.createDataFrame([("1", "urn:r", "http://x/", "2024-01-01T00:00:00Z", bytearray(message))],
                                      "source_id string, record_id string, target_uri string, date string, message binary")
    made = warc.derivative_records(responses).filter("record_type = 'metadata'").collect()
    (_, block), = warc.parse(bytes(made[0].record))
    http = json.loads(block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["Headers"] == {"Content-Type": "text/html", "Set-Cookie": ["a=1", "b=2"], "Vary": "Accept"}


def conversions(spark, *messages):
    rows = [(str(i), f"<urn:{i}>", "u", "d", m) for i, m in enumerate(messages)]
    made = warc.derivative_records(spark.createDataFrame(
        rows, "source_id string, record_id string, target_uri string, date string, message binary")).collect()
    assert sum(r.record_type == "metadata" for r in made) == len(messages)
    for r in made:
        headers, block = warc.parse(bytes(r.record))[0]
        assert headers["WARC-Refers-To"] == f"<urn:{r.source_id}>" and len(block) == r.content_length
    return {int(r.source_id): warc.parse(bytes(r.record))[0][1].decode() for r in made if r.record_type == "conversion"}


def http(body, *lines):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *(x.encode() for x in lines), b"", body])


def test_real_responses(spark):
    """Headers without a space, charsets, compression, chunks, and types that are no text."""
    page = "<p>café &amp; thé</p>"
    latin, squeezed = page.encode("latin-1"), gzip.compress(page.encode())
    chunks = b"5;x=1\r\n" + squeezed[:5] + b"\r\n" + f"{len(squeezed) - 5:X}".encode() + b"\r\n" + squeezed[5:] + b"\r\n0\r\n\r\n"
    got = conversions(
        spark, http(latin, "Content-Type:text/html; charset=iso-8859-1"), http(page.encode(), "content-type: text/html"),
        http(squeezed, "Content-Encoding: gzip", "Content-Type: text/html;charset=\"UTF-8\""),
        http(chunks, "Content-Encoding:gzip", "Transfer-Encoding: chunked"),
        http(zlib.compress(page.encode()), "Content-Encoding: deflate"),
        http(b"%PDF-1.4 <p>x</p>", "Content-Type: application/pdf"), http(b"a <b> c", "Content-Type: text/plain"),
        http(b"<meta charset=windows-1252><p>caf\xe9 \x80</p>"), http(page.encode("utf-16"), "Content-Type: text/html"),
        http(b"<p>a\xffb</p>", "Content-Type: text/html; charset=no-such"), http(b"\x1f\x8bbroken", "Content-Encoding: gzip",
                                                                                 "Content-Type: image/png"),
        http(b"<p>plain</p>", "Content-Encoding: gzip", "Transfer-Encoding: chunked"))
    text = "café & thé"
    assert got == {0: text, 1: text, 2: text, 3: text, 4: text, 6: "a <b> c", 7: "café €", 8: text, 9: "a�b", 11: "plain"}
    assert warc.split_http(http(b"", "A:1", "B:  two words ", "C"))[1] == [("A", "1"), ("B", "two words"), ("C", "")]
