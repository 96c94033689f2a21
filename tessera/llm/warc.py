"""WARC derivatives (operator 8): metadata and plain-text conversion records linked to their responses.

`responses` writes pages as WARC/1.1 response records.  `derived` reads raw response records and gives two records for each: a
`metadata` record, whose body lists the source's record and HTTP headers and digests as fields, and a `conversion`
record with the plain text of an HTML or text payload.  Both carry WARC-Refers-To, target URI and date of
the source, and digests of their own blocks.  Record ids are name-based UUIDs, so a rerun gives the same ones.

A payload is read through its transfer and content encodings (chunked, gzip, deflate) before its text is taken; digests are of the
bytes as they stand in the record.  `read` splits .warc and .warc.gz files into records, and `write` packs each
record as a gzip member of its own, which put one after another are a .warc.gz file.

Defined results: a null page is an empty payload; a null url is the empty target; a record that can't be parsed, or isn't a
response, gives a metadata record with an `error` field and no conversion; a payload whose encoding is unknown or broken, or of
another type than text, is converted to no record, and the metadata record says so; a charset that is unknown, or no charset of
texts, is read as UTF-8; very long payloads are converted whole; repeated rows give repeated records, and rows of the same url and page
the same record ids unless `responses` is given a column that tells them apart; an empty table gives an empty result; other columns
pass if named in `keep`.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, column, table
from .html import INLINE, RAW, TAG

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)

#: Codecs of Python that are no charsets of web pages.
NO_CHARSET = frozenset("idna punycode raw-unicode-escape undefined unicode-escape utf-7".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(names))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def response(uri: str, page: bytes, date: str = DATE, name: str = "") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(page)}\r\n\r\n".encode()
    uri = re.sub(r"[\r\n]", " ", uri)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", uri, digest(page), *[name] * bool(name))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest(page)), ("WARC-Block-Digest", digest(http + page)), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, http + page)


def parsed(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = _fields(lines[1:])
    size = int(dict((k.lower(), v) for k, v in headers).get("content-length", "-1"))
    if not 0 <= size <= len(rest):
        raise ValueError("truncated record")
    return headers, rest[:size]


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}")
        elif b":" in line:
            k, _, v = line.partition(b":")
            out.append((k.strip().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace")))
    return out


def plain(page: str) -> str:
    """All text of a page outside of raw elements, a line for each block."""
    lines, now, at = [], [], 0
    while at <= len(page):
        m = TAG.search(page, at)
        now.append(page[at : m.start()] if m else page[at:])
        tag = (m[2] or m[5] or "").lower() if m else ""
        if not m or (tag and tag not in INLINE):
            lines.append(" ".join(entities.unescape("".join(now)).split()))
            now = []
        if not m:
            break
        at = m.end()
        if tag in RAW and tag != "title" and m[2] and not m[1]:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
    return "\n".join(x for x in lines if x)


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; ValueError if it is none."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip() or b"x", 16) if end >= 0 else -1
        if size < 0 or end + 2 + size > len(data):
            raise ValueError("broken chunks")
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def decoded(payload: bytes, http: dict[str, str]) -> bytes:
    """The payload without its transfer and content encodings; ValueError if one is unknown or broken."""
    for name in [x.strip().lower() for k in ("transfer-encoding", "content-encoding") for x in reversed(http.get(k, "").split(","))]:
        try:
            if name == "chunked":
                payload = unchunked(payload)
            elif name in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif name == "deflate":
                try:
                    payload = zlib.decompress(payload)
                except zlib.error:
                    payload = zlib.decompress(payload, -zlib.MAX_WBITS)
            elif name not in ("", "identity"):
                raise ValueError(f"unknown encoding {name}")
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError(f"broken {name}: {e}") from e
    return payload


def text_of(payload: bytes, kind: str) -> str:
    """A payload of a content type as text."""
    m = CHARSET.search(kind.encode()) or CHARSET.search(payload[:1024])
    try:
        found = codecs.lookup(m[1].decode() if m else "utf-8").name
        return payload.decode("utf-8" if found in NO_CHARSET else found, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derivatives(raw: bytes) -> list[dict]:
    """The metadata and conversion records of a response."""
    try:
        headers, block = parsed(raw)
        by = {k.lower(): v for k, v in headers}
        if by.get("warc-type") != "response":
            raise ValueError("no response")
    except ValueError as e:
        body = f"error: {e}\r\n".encode()
        return [_derived("metadata", record_id("error", digest(raw)), "", DATE, "", "application/warc-fields", body, [])]
    source, uri, date = by.get("warc-record-id", ""), by.get("warc-target-uri", ""), by.get("warc-date", DATE)
    head, mark, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    http = _fields(lines)
    kind = {k.lower(): v for k, v in http}.get("content-type", "")
    found = by.get("warc-payload-digest") or digest(payload)
    fields = [("source-" + k.lower(), v) for k, v in headers] + [("http-status", status.decode("utf-8", "replace"))] + [("http-" + k.lower(), v) for k, v in http]
    fields += [("payload-length", str(len(payload))), ("payload-digest-computed", digest(payload)), ("payload-digest-matches", str(found == digest(payload)).lower())]
    name, text = kind.split(";")[0].strip().lower(), None
    if mark and (name == "application/xhtml+xml" or name.startswith("text/")):
        try:
            text = text_of(decoded(payload, {k.lower(): v for k, v in http}), kind)
            text = plain(text) if "html" in name else text
        except ValueError as e:
            fields.append(("conversion-error", re.sub(r"[\r\n]", " ", str(e))))
    out = [_derived("metadata", source, uri, date, found, "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode(), [])]
    if text is not None:
        out.append(_derived("conversion", source, uri, date, found, "text/plain; charset=utf-8", text.encode("utf-8", "replace"), [("X-Source-Content-Type", kind)]))
    return out


def _derived(kind: str, source: str, uri: str, date: str, source_digest: str, content: str, block: bytes, more: list[tuple[str, str]]) -> dict:
    own = record_id(kind, source, uri, source_digest)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Block-Digest", digest(block)), ("X-Source-Payload-Digest", source_digest), ("Content-Type", content), *more]
    return {"warc_type": kind, "record_id": own, "refers_to": source, "target_uri": uri, "warc_date": date, "source_payload_digest": source_digest, "block_digest": digest(block), "content_length": len(block), "record": record(headers, block)}


DERIVED = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("source_payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("record", pa.binary())])
#: Bytes of records in a batch that leaves a task.
OUT_BYTES = 16 << 20


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [response(u.as_py() or "", (p.as_py() or "").encode(), name=n.as_py() or "") for u, p, n in zip(batch.column(0), batch.column(1), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(raw, pa.binary())], [*batch.schema.names[3:], "response"])


def _derivatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows, size = [], [], 0

        def out(at, rows, batch=batch):
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]]
            made = pa.Table.from_pylist(rows, DERIVED).combine_chunks()
            return pa.RecordBatch.from_arrays([*kept, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made.columns)], [*batch.schema.names[1:], *DERIVED.names])

        for i, raw in enumerate(batch.column(0)):
            for one in derivatives(raw.as_py() or b""):
                at.append(i)
                rows.append(one)
                size += len(one["record"])
            if size > OUT_BYTES:
                yield out(at, rows)
                at, rows, size = [], [], 0
        if rows:
            yield out(at, rows)


def responses(pages: DataFrame, keep: list[str] | None = None, key: str | None = None) -> DataFrame:
    """pages' columns `keep` with response, a raw WARC response record of url and html; key: a column that goes into the record's id."""
    kept = Kept(pages, keep or ["page_id"], ("response",))
    name = column(key).cast("string") if key else F.lit("")
    out = pages.select(F.col("url").alias("__url"), F.col("html").alias("__html"), name.alias("__name"), *kept.columns).mapInArrow(_responses, f"{kept.kinds}response binary")
    return out.select(*kept.back, "response")


def records(data: bytes) -> Iterator[bytes]:
    """The records of a file's bytes (plain, or gzip in one or many members); what follows a broken one is one record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = re.search(rb"\r\ncontent-length:\s*(\d+)\s*(?:\r\n|\Z)", data[at:head], re.I) if head >= 0 else None
        end = head + 4 + int(size[1]) if size else len(data) + 1
        if end > len(data):
            yield data[at:]
            return
        yield data[at:end] + b"\r\n\r\n"
        at = end
        while data[at : at + 2] == b"\r\n":
            at += 2


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held: list[bytes] = []
            size = 0
            for one in records(data.as_py() or b""):
                held.append(one)
                size += len(one)
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(held, pa.binary())], ["path", "response"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(held, pa.binary())], ["path", "response"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, response): the records of the .warc and .warc.gz files of a folder; a file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_split, "path string, response binary")


def write(rows: DataFrame, path: str, name: str = "record") -> None:
    """The records of a column as a table of gzip members (column value); `joined` makes a .warc.gz file of them."""
    packed = rows.select(F.col(name).alias("record")).mapInArrow(_packed, "value binary")
    packed.write.parquet(path)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x.as_py() or b"", mtime=0) for x in batch.column(0)], pa.binary())], ["value"])


def joined(members: Iterator[bytes]) -> bytes:
    """A .warc.gz file of gzip members."""
    return b"".join(members)


def derived(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The derivatives of raw response records (column response), with the columns `keep` of their sources."""
    kept = Kept(records, keep or ["page_id"], tuple(DERIVED.names))
    schema = f"{kept.kinds}warc_type string, record_id string, refers_to string, target_uri string, warc_date string, source_payload_digest string, block_digest string, content_length long, record binary"
    return records.select("response", *kept.columns).mapInArrow(_derivatives, schema).select(*kept.back, *DERIVED.names)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derived(responses(table(spark, sf_dir, "pages"), key="page_id"))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "source_payload_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


QUERIES = {"op8_warc_derivatives": op8_warc_derivatives}
