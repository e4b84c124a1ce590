"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response record holds an HTTP message. From each one two records are built, as a crawl's
metadata and text files hold them: ``metadata`` (JSON: the source's headers, HTTP status and headers,
title, links, digests) and ``conversion`` (the page's text). Both name the response in
``WARC-Refers-To`` and keep its target, date and payload digest.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lateweave:warc")
_PART = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s>/]*)"
                   r"((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
_HREF = re.compile(r"""\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
RECORD = ("source_id string, record_type string, record_id string, refers_to string, target_uri string, "
          "content_type string, content_length bigint, block_digest string, source_payload_digest string, "
          "record binary")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same identifier, so a record that is built again does not change."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _header(value: str) -> str:
    return " ".join(value.split())


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A whole record: version, header lines, block, two empty lines. Headers without value are left out."""
    lines = [VERSION, *(f"{k}: {_header(v)}" for k, v in headers if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in ``data``."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(header_field(line) for line in lines[1:])
        size = int(headers["Content-Length"])
        out.append((headers, data[end + 4:end + 4 + size]))
        at = end + 4 + size + 4
    return out


def header_field(line: str) -> tuple[str, str]:
    """Name and value: what is before the first colon, and what is behind it without outer spaces."""
    name, _, value = line.partition(":")
    return name.strip(), value.strip()


def split_http(message: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header lines and payload; a message without an empty line is all payload."""
    head, gap, payload = message.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], message
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [header_field(x) for x in lines], payload


def header_values(fields: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Value by header, a list in order if its lines repeat; case apart, names are spelt as at first."""
    found: dict[str, tuple[str, list[str]]] = {}
    for name, value in fields:
        found.setdefault(name.lower(), (name, []))[1].append(value)
    return {name: values if len(values) > 1 else values[0] for name, values in found.values()}


_MARKUP = frozenset(["text/html", "application/xhtml+xml"])
_META_CHARSET = re.compile(rb"""<meta\b[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)


def _first(fields: list[tuple[str, str]], name: str) -> str:
    return next((v for n, v in fields if n.lower() == name), "")


def _unchunked(data: bytes) -> bytes | None:
    """The chunks of a chunked body put together; None if it is none."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(data):
            return None
        if not size:
            return b"".join(out)
        out.append(data[end + 2:end + 2 + size])
        at = end + 2 + size + 2


def _inflated(data: bytes, wbits: int) -> bytes | None:
    try:
        return zlib.decompressobj(wbits).decompress(data)
    except zlib.error:
        return None


def decoded_body(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without chunks and compression; what does not decode, or is unknown, stays as it is."""
    codings = f"{_first(fields, 'content-encoding')},{_first(fields, 'transfer-encoding')}".lower().split(",")
    for coding in reversed([c.strip() for c in codings]):
        plain = None
        if coding == "chunked":
            plain = _unchunked(payload)
        elif coding in ("gzip", "x-gzip"):
            plain = _inflated(payload, 31)
        elif coding == "deflate":
            plain = _inflated(payload, 15)
            plain = _inflated(payload, -15) if plain is None else plain
        payload = payload if plain is None else plain
    return payload


def body_text(fields: list[tuple[str, str]], payload: bytes) -> tuple[str, str] | None:
    """Media type and text of a payload; None for a type that is no text.

    The charset is that of the header, else of a byte order mark, else of a ``meta`` element, else
    UTF-8, also where its name is unknown. Without a type the payload is taken for a page.
    """
    media, *parameters = _first(fields, "content-type").split(";")
    media = media.strip().lower() or "text/html"
    if not (media.startswith("text/") or media in _MARKUP or media.endswith(("/xml", "+xml", "/json", "+json"))):
        return None
    body = decoded_body(fields, payload)
    named = [v.strip().strip("\"'") for k, _, v in (p.partition("=") for p in parameters) if k.strip().lower() == "charset"]
    marks = [name for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"),
                                     (codecs.BOM_UTF16_BE, "utf-16")) if body.startswith(mark)]
    meta = _META_CHARSET.search(body[:2048])
    for charset in (*named, *marks, *([meta[1].decode("latin-1")] if meta else [])):
        try:
            return media, body.decode(charset, errors="replace")
        except (LookupError, UnicodeError):
            continue
    return media, body.decode("utf-8", errors="replace")


def page_content(markup: str) -> tuple[str, str, list[str]]:
    """Title, plain text (a line per block, no empty lines) and links of a page."""
    out, title, links, in_title = [], [], [], False
    for m in _PART.finditer(markup):
        text, name = m[5], m[3]
        if text is not None:
            (title if in_title else out).append(text)
        elif name is not None:
            name = name.lower()
            if name == "title":
                in_title = not m[2]
            if name in _BLOCK:
                out.append("\n")
            if not m[2] and m[4]:
                links += [html.unescape(next(x for x in h if x) if any(h) else "") for h in _HREF.findall(m[4])]
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return " ".join(html.unescape("".join(title)).split()), "\n".join(x for x in lines if x), links


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Responses from page_id, url, html: source_id, record_id, target_uri, date, message (binary).

    NULL in any column counts as empty. Pages that repeat id, address and text get equal records.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("source_id", "record_id", "target_uri", "date", "message")}
            for page, url, markup in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body = (markup or "").encode()
                rows["source_id"].append(page)
                rows["record_id"].append(record_id("response", page or "", url or "", digest(body)))
                rows["target_uri"].append(url or "")
                rows["date"].append(date)
                rows["message"].append(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
                                       + str(len(body)).encode() + b"\r\n\r\n" + body)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                ("source_id", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                ("date", pa.string()), ("message", pa.binary())]))

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInArrow(
        build, "source_id string, record_id string, target_uri string, date string, message binary")


def derive(record: str, target: str, date: str, message: bytes) -> list[tuple]:
    """(type, id, content type, block, payload digest, serialised record) of the derivatives."""
    status, fields, payload = split_http(message)
    found = body_text(fields, payload)
    title, text, links = "", "", []
    if found:
        title, text, links = page_content(found[1]) if found[0] in _MARKUP else ("", found[1], [])
    source = digest(payload)
    meta = json.dumps({
        "Envelope": {
            "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": record, "WARC-Target-URI": target,
                                     "WARC-Date": date, "WARC-Block-Digest": digest(message),
                                     "WARC-Payload-Digest": source, "Content-Length": str(len(message))},
            "Payload-Metadata": {"HTTP-Response-Metadata": {
                "Response-Message": status, "Headers": header_values(fields), "Entity-Digest": source,
                "Entity-Length": str(len(payload)),
                "HTML-Metadata": {"Title": title, "Links": links}}}}}, ensure_ascii=False).encode()
    out = []
    blocks = [("metadata", "application/json", meta)]
    if found:
        blocks.append(("conversion", "text/plain", text.encode(errors="replace")))
    for kind, content, block in blocks:
        own = record_id(kind, record, digest(block))
        out.append((kind, own, content, block, source, serialise([
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record), ("WARC-Target-URI", target),
            ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Refers-To-Payload-Digest", source),
            ("Content-Type", content), ("Content-Length", str(len(block)))], block)))
    return out


def _message_slices(batches: Iterator[pa.RecordBatch], budget: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of bounded messages; a longer message is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("message")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def derivative_records(responses: DataFrame) -> DataFrame:
    """Two rows per response: its metadata and its conversion record, fields and serialised bytes.

    The text is that of the payload without chunks and compression, by its charset (``body_text``); a
    payload that is no text has no conversion record, and of plain text the conversion is the text.
    Digests cover the payload as it was sent. A message that is no HTTP message is all payload, a
    page; bytes that do not decode become replacement characters. NULL counts as empty.
    Repeated responses give repeated records; an empty table gives none; extra columns are ignored.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _message_slices(batches):
            rows = {f.split()[0]: [] for f in RECORD.split(", ")}
            for source_id, record, target, date, message in zip(*(batch.column(c).to_pylist() for c in (
                    "source_id", "record_id", "target_uri", "date", "message"))):
                for kind, own, content, block, source, whole in derive(record or "", target or "", date or "",
                                                                       message or b""):
                    for k, v in zip(rows, (source_id, kind, own, record, target, content, len(block), digest(block),
                                           source, whole)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                (f.split()[0], {"bigint": pa.int64(), "binary": pa.binary()}.get(f.split()[1], pa.string()))
                for f in RECORD.split(", ")]))

    return responses.select("source_id", "record_id", "target_uri", "date", "message").mapInArrow(build, RECORD)
