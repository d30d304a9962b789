"""WARC records packed in ZIP archives, read back by range.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member per record, a ``warcinfo``
record first, and ``indexes/index.cdxj``, one sorted line per response or revisit: the SURT form of its URI, its time and
its offset and length in the first member. The reader takes the end record (and the ZIP64 end record), walks the central
directory, finds where the members' bytes lie, reads the index piece by piece and then fetches single records by offset
and length. Nothing is extracted and no member is read whole.

A response is an HTTP response whose body is the payload; a revisit has its head and no body. URIs are percent-encoded
where they have to be; what that changes, and page ids, stand in fields of our own (``X-``).

Archives lie in the cluster's shared folder and are opened through Arrow's file systems by URI. Each task writes
one archive under a name of its own and reports it; a table of the reported names is the set of archives, so what
a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Workspace, new_path, qualified, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of archives that a task reads, about, and bytes of an index that are read at a time.
RANGE, CHUNK = 4 << 20, 1 << 20
#: Where a record lies.
LOCATION = "archive string, offset long, length long, payload_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:.")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it for a URI or an absolute path."""
    return pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


# --- archives ---------------------------------------------------------------------------------------------------


class Counting(io.RawIOBase):
    """A write-only stream that knows its position; zipfile writes to it without seeking back."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        data = bytes(data)
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def target_uri(url: str | None, page: int | None) -> str:
    """A URI of ASCII characters for any url; one without a scheme, and none, are named by the page."""
    if not url or not SCHEME.match(url):
        return f"urn:page:{'null' if page is None else page}"
    return quote(url, safe="%!#$&'()*+,/:;=?@[]~-._")


def surt(uri: str) -> str:
    """The sort key of a URI: the host's labels from the right, then the path; other URIs as they are."""
    try:
        parts = urlsplit(uri)
        host, port = parts.hostname, parts.port
    except ValueError:
        return uri.lower()
    if not host:
        return uri.lower()
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return (where + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def record_id(*about: object) -> str:
    """A record's URI, the same for equal facts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(about))}>"


def record(headers: list[tuple[str, str]], block: bytes, body: bytes = b"") -> bytes:
    """One WARC record as a gzip member; its block is ``block`` and ``body``."""
    size = len(block) + len(body)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(size))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8") + block) + z.compress(body) + z.compress(b"\r\n\r\n") + z.flush()


def info_record(date: str) -> bytes:
    fields = b"software: casefile\r\nformat: WARC File Format 1.1\r\n"
    about = [("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")]
    return record(about, fields)


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def page_record(page: int | None, url: str | None, body: bytes, response: int | None, date: str) -> tuple[bytes, str, dict[str, str]]:
    """The record of a page, its URI and what the index says of it; a revisit if another page is the ``response``."""
    sha, uri = digest(body), target_uri(url, page)
    revisit = response is not None and response != page
    kind = "revisit" if revisit else "response"
    own = record_id("revisit", page, sha, url) if revisit else record_id("response", page, sha)
    headers = [("WARC-Type", kind), ("WARC-Date", date), ("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha}")]
    headers += [("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", json.dumps(page)), ("X-Payload-Bytes", str(len(body)))]
    if uri != url:
        headers.append(("X-Url", json.dumps(url)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", response, sha)), ("X-Refers-To-Page", str(response))]
    data = record(headers, http_head(len(body)), b"" if revisit else body)
    return data, uri, {"url": uri, "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{sha}"}


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one gzip member: the HTTP body, or the block of other content."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name to (start of its bytes, their number) for the stored members of a ZIP file.

    f: a file with ``seek`` and ``read``; size: its length. Members that are compressed or encrypted raise.
    """
    back = min(size, 22 + 65535 + 20)
    f.seek(size - back)
    tail = f.read(back)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        f.seek(end64)
        end = f.read(56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end record")
        n, length, start = struct.unpack("<QQQ", end[32:56])
    f.seek(start)
    directory, out, pos = f.read(length), {}, 0
    for _ in range(n):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        flags, method = struct.unpack("<HH", directory[pos + 8 : pos + 12])
        packed, full, name_len, extra_len, comment_len = struct.unpack("<IIHHH", directory[pos + 20 : pos + 34])
        (local,) = struct.unpack("<I", directory[pos + 42 : pos + 46])
        name = directory[pos + 46 : pos + 46 + name_len].decode("utf-8")
        extra = directory[pos + 46 + name_len : pos + 46 + name_len + extra_len]
        e = 0
        while e + 4 <= len(extra):
            kind, size_of = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                values = list(struct.unpack(f"<{size_of // 8}Q", extra[e + 4 : e + 4 + size_of // 8 * 8]))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            e += 4 + size_of
        if method != 0 or flags & 1 or packed != full:
            raise ValueError(f"{name} is not stored")
        f.seek(local)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        out[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), full)
        pos += 46 + name_len + extra_len + comment_len
    return out


# --- Spark jobs -------------------------------------------------------------------------------------------------


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row and return the archives: archive, records, bytes.

    Payload: the html in UTF-8, empty for null. Of records with equal payloads of at least ``min_bytes`` bytes the
    one with the largest id is a response and the others are revisits without payload that name it. ``date`` is the time
    of all records, as the pages have none. The archives stay until the workspace around ends.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    raw = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    raw = raw.withColumn("sha", F.sha1("payload"))
    seen = raw.filter(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("copies"))
    stamp = re.sub(r"\D", "", date)[:14]
    with Workspace() as w:
        copied = written(seen.filter("copies > 1").select(F.col("sha").alias("c_sha"), "response"), "warc-copies")
        rows = raw.join(copied, F.col("sha") == F.col("c_sha"), "left").drop("c_sha", "sha")
        base = qualified(spark, w.keep(new_path(spark, "warc")))
        fs, path = open_fs(base)
        fs.create_dir(path, recursive=True)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, count, offset, index, zf, sink, member = "", 0, 0, [], None, None, None
            for batch in batches:
                for at in range(batch.num_rows):
                    if zf is None:
                        name = f"{base}/{uuid.uuid4().hex}.zip"
                        own, own_path = open_fs(name)
                        sink = own.open_output_stream(own_path)
                        zf = zipfile.ZipFile(Counting(sink), "w", zipfile.ZIP_STORED, allowZip64=True)
                        member = zf.open(DATA, "w", force_zip64=True)
                        data = info_record(date)
                        member.write(data)
                        offset = len(data)
                    page, url, body, response = (batch.column(i)[at].as_py() for i in range(4))
                    data, uri, about = page_record(page, url, body, response, date)
                    member.write(data)
                    about |= {"length": str(len(data)), "offset": str(offset), "filename": "data.warc.gz", "bytes": str(len(body))}
                    index.append(f"{surt(uri)} {stamp} {json.dumps(about)}")
                    offset += len(data)
                    count += 1
            if zf is not None:
                member.close()
                with zf.open(INDEX, "w", force_zip64=True) as f:
                    for line in sorted(index):
                        f.write(line.encode() + b"\n")
                zf.close()
                sink.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([offset], pa.int64())], ["archive", "records", "bytes"])

        return w.keep(written(rows.mapInArrow(pack, "archive string, records long, bytes long"), "warc-archives"))


def index_lines(f, start: int, size: int) -> Iterator[dict[str, str]]:
    """What the lines of an index say, read in pieces of ``CHUNK`` bytes."""
    f.seek(start)
    held = b""
    while size > 0:
        piece = f.read(min(CHUNK, size))
        if not piece:
            raise ValueError("the index ends early")
        size -= len(piece)
        *lines, held = (held + piece).split(b"\n")
        yield from (json.loads(x.split(b" ", 2)[2]) for x in lines if x)
    if held:
        yield json.loads(held.split(b" ", 2)[2])


def locate(archives: DataFrame) -> DataFrame:
    """The records of archives by their indexes: archive, offset, length, payload_bytes; offsets are in the ZIP file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = open_fs(name)
                with fs.open_input_file(path) as f:
                    found = members(f, f.size())
                    base = found[DATA][0]
                    part: list[tuple[int, int, int]] = []

                    def flush() -> pa.RecordBatch:
                        columns = [pa.array(c, pa.int64()) for c in zip(*part, strict=True)]  # noqa: B023
                        return pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *columns], ["archive", "offset", "length", "payload_bytes"])  # noqa: B023

                    for line in index_lines(f, *found[INDEX]):
                        part.append((base + int(line["offset"]), int(line["length"]), int(line["bytes"])))
                        if len(part) == 10_000:
                            yield flush()
                            part.clear()
                    if part:
                        yield flush()

    return archives.select("archive").mapInArrow(work, LOCATION)


def fetch(locations: DataFrame, payloads: bool = True) -> DataFrame:
    """Read located records by range: page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload].

    Payload is null for revisits. A response whose bytes do not give its digest raises.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    names = T._parse_datatype_string(schema).names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, rows = None, None, []

        def flush():
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds[: len(names)], strict=True)], names)

        for batch in batches:
            held = 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    fs, path = open_fs(archive)
                    name, f = archive, fs.open_input_file(path)
                h, body = parse_record(f.read_at(length, offset))
                sha = h["warc-payload-digest"].removeprefix("sha1:")
                revisit = h["warc-type"] == "revisit"
                if not revisit and (digest(body) != sha or len(body) != int(h["x-payload-bytes"])):
                    raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                url = json.loads(h["x-url"]) if "x-url" in h else h["warc-target-uri"]
                row = (json.loads(h["x-page-id"]), url, h["warc-type"], int(h["x-payload-bytes"]), sha, int(h["x-refers-to-page"]) if revisit else None)
                rows.append((*row, None if revisit else body) if payloads else row)
                held += len(body)
                if len(rows) >= 2000 or payloads and held > 16 << 20:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()
        if f is not None:
            f.close()

    return locations.select("archive", "offset", "length").mapInArrow(work, schema)


def pack_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write the archives and read every record back; columns as of ``fetch``.

    Null html is an empty payload. Null ids write ``null`` as id; such a record is a response only if no equal payload
    has an id. Of repeated rows with the largest id all are responses, with one record id. Urls of any text, null too,
    come back as written. A payload of any length is one record, which a task holds whole. An empty table writes no
    archive. Other columns are not read.
    """
    archives = write(pages, id_col, url_col, html_col, min_bytes)
    n, size = archives.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    found = locate(archives.repartition(max(1, n), "archive"))
    # Ranges of an archive go to different tasks; within one, reads go forward.
    found = found.repartition(max(1, -(-size // RANGE)), F.col("archive"), F.floor(F.col("offset") / RANGE)).sortWithinPartitions("archive", "offset")
    return fetch(found, payloads)
