"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response record (WARC/1.1) becomes two records.  The ``metadata`` record lists
what the HTTP answer said and the page's outgoing links; the ``conversion``
record holds the plain text.  Both name the response by WARC-Refers-To, keep its
target URI and date, carry its digests on as WARC-Source headers, and have
record ids that follow from the response's, so that a repeated run writes the
same bytes.  Files are read record by record, and damaged ones as far as they go.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dom import parse

DERIVED = (
    "page_id long, url string, warc_type string, record_id string, refers_to string, warc_date string, content_type string, "
    "source_digest string, block_digest string, payload_length long, n_links long, record binary"
)
_NAMES = [x.split()[0] for x in DERIVED.split(", ")]
_CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: str) -> str:
    """A urn:uuid that is a function of ``parts``."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; header values have line breaks folded to spaces, as a header is one line."""
    lines = [b"WARC/1.1"] + [f"{k}: {' '.join(v.split())}".encode("utf-8", "replace") for k, v in headers]
    lines.append(f"Content-Length: {len(block)}".encode())
    return _CRLF.join(lines) + _CRLF * 2 + block + _CRLF * 2


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file in pieces, gzip members unpacked one after another; a damaged member ends them."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            while not member.eof and at < len(data):
                piece = view[at : at + step]
                yield member.decompress(piece)
                at += len(piece) - len(member.unused_data)
        except zlib.error:
            return


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a file, gzipped by record, as a whole, or not at all.

    A record that the file's end or a damaged gzip member cuts off is returned as far as it goes, and one without a
    valid Content-Length up to the next record; either has header ``x-truncated``.  At most one record is held.
    """
    pieces, held = _inflated(data), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    def find(mark: bytes, at: int) -> int:
        while (found := held.find(mark, at)) < 0:
            at = max(at, len(held) - len(mark) + 1)
            if not more():
                return -1
        return found

    while (start := find(b"WARC/", 0)) >= 0:
        del held[:start]
        end = find(_CRLF * 2, 0)
        if end < 0:
            return
        headers: dict[str, str] = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size, first = headers.get("content-length", "0"), end + 4
        if size.isascii() and size.isdigit():
            last = first + int(size)
            while len(held) < last and more():
                pass
            if len(held) < last:
                headers["x-truncated"] = "length"
        else:
            last = find(_CRLF * 2 + b"WARC/", first)
            last = last if last >= 0 else len(held)
            headers["x-truncated"] = "unspecified"
        yield headers, bytes(held[first:last])
        del held[:last]


_BETWEEN = _CRLF * 2 + b"WARC/1."


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(content): a row for each record of the WARC files at ``path``, gzipped or not, for ``derivatives``.

    Spark's text reader cuts the files between records, so that a task holds a record and not a file, files that are
    not gzipped are split, and any store that Spark reads will do.  A record that has the cut within its block is put
    together again by its Content-Length, unless it lies across two splits.
    """
    cells = spark.read.option("lineSep", _BETWEEN.decode()).text(path).select(F.col("value").cast("binary").alias("content"))

    def lacks(record: bytes) -> int:
        for headers, block in read_records(record):
            size = headers.get("content-length", "0")
            return int(size) - len(block) if size.isascii() and size.isdigit() else 0
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gap = None, 0
        for batch in batches:
            out = []
            for cell in batch.column(0).to_pylist():
                if held is not None and gap >= len(_BETWEEN) + len(cell):
                    held += _BETWEEN + cell
                    gap -= len(_BETWEEN) + len(cell)
                else:
                    if held is not None:
                        out.append(held)
                    held = cell if cell.startswith(b"WARC/") else b"WARC/1." + cell
                    gap = lacks(held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], ["content"])

    return cells.mapInArrow(run, "content binary")


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and body of an HTTP message; without a status line all is body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(_CRLF * 2)
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def _unchunked(body: bytes) -> bytes:
    """A chunked body put together, as far as its chunks are sound; one that has no chunk is returned as it is."""
    out, at = [], 0
    while (end := body.find(_CRLF, at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            break
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else body


def decoded(http: dict[str, str], body: bytes) -> tuple[bytes, bytes | None]:
    """The body without its transfer encoding, and the content without its content encoding; None if that one is unknown."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    content = body
    for code in reversed([x.strip().lower() for x in http.get("content-encoding", "").split(",")]):
        if code in ("", "identity"):
            continue
        if code not in ("gzip", "x-gzip", "deflate"):
            return body, None
        zipped = zlib.decompressobj(47 if code != "deflate" or content[:1] == b"x" else -15)
        try:
            content = zipped.decompress(content)  # a cut stream: as far as it goes
        except zlib.error:
            if content[:2] == b"\x1f\x8b":
                return body, None  # else it was unpacked when it was stored
    return body, content


_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s{0,9}=\s{0,9}[\"']?([A-Za-z0-9_.:-]{1,40})", re.I)


def as_text(kind: str, content: bytes) -> str:
    """Content by the charset of its type, or that which the first KB of a page names, or UTF-8; bytes that are not in it are replaced."""
    charset = next((v.strip("\"' ") for k, _, v in (p.strip().partition("=") for p in kind.split(";")[1:]) if k.strip().lower() == "charset"), "")
    if not charset and (m := _CHARSET.search(content[:1024])):
        charset = m[1].decode()
    try:
        return content.decode(charset or "utf-8", "replace")
    except (LookupError, UnicodeError):
        return content.decode("utf-8", "replace")


def response(url: str | None, html: str | None, date: str, number: int = 0) -> bytes:
    """A response record for a page: the source of the derivatives where a crawl has kept url and html only."""
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(body)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(number), url or "", digest(body))),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", digest(body)),
        ("WARC-Block-Digest", digest(http + body)),
    ]
    return write_record(headers, http + body)


def _absolute(links: list[str], base: str) -> list[str]:
    out = []
    for link in links:
        if link and not link.startswith(("#", "javascript:")):
            try:
                out.append(urljoin(base, link))
            except ValueError:
                out.append(link)
    return out


#: Headers of a response that its derivatives carry in headers of their own.
_CARRIED = frozenset("warc-type warc-record-id warc-date warc-target-uri warc-payload-digest warc-block-digest content-type content-length x-truncated".split())


def derive(headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record; other records give none.

    Pages become the text of their blocks and text of other kinds stays as it is; content that is no text, or in an
    encoding that is not known here, has a metadata record only, which names that.  All HTTP headers and the other
    WARC headers of the response are in the metadata.
    """
    if headers.get("warc-type") != "response":
        return []
    status, fields_of, raw = split_http(block)
    http = {k.lower(): v for k, v in reversed(fields_of)}
    url, source, date = (headers.get(k, "") for k in ("warc-target-uri", "warc-record-id", "warc-date"))
    body, content = decoded(http, raw)
    payload = headers.get("warc-payload-digest") or digest(body)
    kind = http.get("content-type", "")
    media = kind.partition(";")[0].strip().lower()
    links, text = [], None
    if content is not None and media in ("", "text/html", "application/xhtml+xml"):
        page = parse(as_text(kind, content))
        links, text = _absolute(page.links, url), "\n".join(t for _, t in page.blocks)
    elif content is not None and media.startswith("text/"):
        text = as_text(kind, content)
    fields = [("source-status", status), ("source-content-type", kind), ("source-content-length", str(len(raw)))]
    fields.append(("source-block-digest", headers.get("warc-block-digest") or digest(block)))
    fields.append(("text-length", str(len(text))) if text is not None else ("text-missing", http.get("content-encoding", "") if content is None else media))
    if "x-truncated" in headers:
        fields.append(("source-truncated", headers["x-truncated"]))
    fields += [(f"source-{k}", v) for k, v in headers.items() if k not in _CARRIED]
    fields += [(f"source-http-{k.lower()}", v) for k, v in fields_of if k]
    fields = [(k, " ".join(v.split())) for k, v in fields] + [("outlink", " ".join(x.split())) for x in links]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode("utf-8", "replace")),
    }
    if text is not None:
        blocks["conversion"] = ("text/plain; charset=utf-8", text.encode("utf-8", "replace"))
    out = []
    for derived, (content_type, data) in blocks.items():
        own = record_id(derived, source, payload)
        names = [
            ("WARC-Type", derived), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date),
            ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", content_type), ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(data)),
            ("WARC-Truncated", headers.get("warc-truncated") or headers.get("x-truncated", "")),
        ]
        out.append({
            "url": url, "warc_type": derived, "record_id": own, "refers_to": source, "warc_date": date, "content_type": content_type, "source_digest": payload,
            "block_digest": digest(data), "payload_length": len(data), "n_links": len(links), "record": write_record([n for n in names if n[1]], data),
        })
    return out


def derivatives(files: DataFrame, content: str = "content") -> DataFrame:
    """DERIVED records of WARC records or files (a binary column, as ``read_warc`` or ``binaryFile`` reads them); page_id is null.

    Null and empty files, and files without responses, give no records; damaged ones give those of what can be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for headers, block in read_records(data.as_py() or b""):
                    if rows := derive(headers, block):
                        yield _batch([{"page_id": None, **r} for r in rows])

    return files.select(F.col(content).cast("binary")).mapInArrow(run, DERIVED)


def page_derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", with_records: bool = True) -> DataFrame:
    """DERIVED records, two for each row of ``pages``: its response record is written, read back, and derived from.

    Null urls and htmls count as empty (an empty target URI is left out of the records); repeated rows give equal
    records; an empty table gives none.  ``with_records=False`` leaves the bytes null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns)):
                    for headers, block in read_records(response(url, html, date, page_id or 0)):
                        rows += [{"page_id": page_id, **r} for r in derive(headers, block)]
                if not with_records:
                    rows = [{**r, "record": None} for r in rows]
                if rows:
                    yield _batch(rows)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, DERIVED)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[x.split()[1]]) for n, x in zip(_NAMES, DERIVED.split(", "))], _NAMES)
