"""Web archives: a converter of legacy ARC files to WARC, a writer and a reader.

ARC (versions 1 and 2): a version block (filedesc://, the first record only) and then records, each one header line of 5 or 10 fields that
ends with the declared length, the content of that length, and a line end. The converter reads header lines by the
version that the version block names, trusts the declared length, and synthesises what WARC wants: record identifiers
(UUIDs of the record's address, time and digest, so that a converted archive is the same each time), timestamps in
ISO form, record types (warcinfo, response, resource, revisit) and SHA-256 digests of block and payload.

Files are gzip members, one a record, and are written where driver and executors both see them, each under a name of its
own attempt; a manifest row is committed with its task, so files of lost attempts are never read.

Defined results: null html is an empty payload, a null url a URN; a null page_id stays null. Rows that repeat the page_id
and payload of a response are responses too. Payloads of under 100 bytes are never revisits. A very long page is a few
copies of itself in the task that writes or reads it. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import Work, lookup, spread

#: Payloads from so many bytes are stored once.
REVISIT_BYTES = 100
#: Bytes after which a new archive begins; gzip level.
ARCHIVE_BYTES, LEVEL = 1 << 30, 3
ARC_DATE, NO_URL = "20000101000000", "urn:none"
#: A field of our own: the page that a revisit refers to.
REFERS_TO_PAGE = "WARC-Refers-To-Page"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The fields of header lines, by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes
    opens: bool = False  # the version block


@dataclass
class WarcRecord:
    kind: str
    headers: dict[str, str]
    block: bytes = b""
    extra: dict[str, str] = field(default_factory=dict)


# ---------------------------------------------------------------- ARC


def arc_version_block(version: int, name: str, date: str = ARC_DATE) -> bytes:
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 hushframe\n{names[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain " + (f"{len(body)}\n" if version == 1 else f"200 - - 0 {name} {len(body)}\n")
    return head.encode() + body + b"\n"


def address(url: str) -> str:
    """A URL as a header line holds it."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "-"


def arc_record(version: int, url: str, content: bytes, name: str = "-", date: str = ARC_DATE, mime: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    url = address(url)
    middle = "" if version == 1 else f"200 {zlib.crc32(content):08x} - 0 {name} "
    return f"{url} {ip} {date} {mime} {middle}{len(content)}\n".encode() + content + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an (uncompressed) ARC file. Raises ValueError where a header line or a length is broken."""
    version, begun = 1, False
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        first, begun = not begun and line.startswith(b"filedesc://"), True
        names = ARC_FIELDS[2] if first and len(parts) == 10 else ARC_FIELDS[1] if first else ARC_FIELDS[version]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line: {line[:200]!r}")
        values = dict(zip(names, parts))
        content = stream.read(int(values["length"]))
        if len(content) != int(values["length"]):
            raise ValueError("an ARC record ends before its declared length")
        if first:
            said = content.split(b" ", 1)[0]
            version = int(said) if said in (b"1", b"2") else 1
        yield ArcRecord(version, values, content, first)


# ---------------------------------------------------------------- ARC -> WARC


def timestamp(arc_date: str) -> str:
    """YYYYMMDDhhmmss (or its beginning) in ISO form."""
    digits = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(arc_date) :])[:14] if len(arc_date) < 14 else arc_date[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and body; all body if there is no head."""
    at = content.find(b"\r\n\r\n")
    return (content[: at + 4], content[at + 4 :]) if content.startswith(b"HTTP/") and at >= 0 else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("latin-1")
    return None


def convert(records: Iterable[ArcRecord], refers: dict[str, tuple[str, str]] | None = None) -> Iterator[WarcRecord]:
    """WARC records of ARC records. refers: page id -> page id and address of the response that has the same payload."""
    for r in records:
        date, url = timestamp(r.fields["date"]), r.fields["url"]
        if r.opens:
            yield WarcRecord("warcinfo", {"WARC-Record-ID": record_id(url, date), "WARC-Date": date, "WARC-Filename": url[11:], "Content-Type": "application/warc-fields"}, f"software: hushframe\r\nformat: converted from ARC version {r.version}\r\n".encode())
            continue
        head, body = split_http(r.content)
        payload, page = digest(body), http_field(head, "X-Page-Id")
        original = (refers or {}).get(page) if page is not None else None
        h = {"WARC-Record-ID": record_id(url, date, page or "", payload), "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{payload}"}
        if r.fields["ip"] not in ("", "-", "0.0.0.0"):
            h["WARC-IP-Address"] = r.fields["ip"]
        if original is not None:
            kind, block = "revisit", head
            first, at = original
            h |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(at, date, first, payload), "WARC-Refers-To-Target-URI": at, "WARC-Refers-To-Date": date, REFERS_TO_PAGE: first, "Content-Type": "application/http; msgtype=response"}
        elif head:
            kind, block = "response", r.content
            h["Content-Type"] = "application/http; msgtype=response"
        else:
            kind, block = "resource", r.content
            h["Content-Type"] = r.fields["type"]
        yield WarcRecord(kind, h | {"WARC-Block-Digest": f"sha256:{digest(block)}"}, block)


# ---------------------------------------------------------------- WARC


def warc_bytes(r: WarcRecord) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: {r.kind}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r.headers.items()) + f"Content-Length: {len(r.block)}\r\n\r\n"
    return head.encode() + r.block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """The records of a gzipped WARC file. Raises ValueError on a broken one, or on a block of another digest."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        headers: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k] = v
        size = int(headers.pop("Content-Length"))
        block = f.read(size)
        if len(block) != size or f.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends early")
        if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha256:{digest(block)}":
            raise ValueError(f"another block than {headers['WARC-Record-ID']} had")
        yield WarcRecord(headers.pop("WARC-Type"), headers, block)


def _id_out(page: str | None) -> str | None:
    return None if page is None else quote(page, safe="")


def _id_in(page: str | None) -> str | None:
    return None if page is None else unquote(page)


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, refers_url: of equal payloads of REVISIT_BYTES or more, all but the smallest page_id refer to it (and to its url)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(body) >= REVISIT_BYTES, F.sha2(body, 256)).alias("__d"))
    first = F.min(F.struct("page_id", "url"))
    groups = rows.where("__d is not null").groupBy("__d").agg(first.alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__d", "__first")
    refers = F.when(F.col("__first.page_id") != F.col("page_id"), F.col("__first"))
    return lookup(rows, groups, "__d").withColumn("__refers", refers).select("page_id", "url", "html", F.col("__refers.page_id").alias("refers_to"), F.col("__refers.url").alias("refers_url"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html, refers_to, refers_url through ARC records into WARC files under folder; returns the manifest (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out = path = None
        size = records = 0
        done: list[tuple[str, int]] = []
        for b in batches:
            for page, url, html, refers, refers_url in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                body = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"X-Page-Id: {_id_out(page)}\r\n" if page is not None else "") + "\r\n"
                version = 1 + zlib.crc32((page or "").encode()) % 2
                arc = arc_version_block(version, path.rsplit("/", 1)[1]) + arc_record(version, url if url is not None else NO_URL, head.encode() + body)
                for r in convert(read_arc(io.BytesIO(arc)), {_id_out(page): (_id_out(refers), address(NO_URL if refers_url is None else refers_url))} if refers is not None else None):
                    if r.kind != "warcinfo" or not records:
                        size += out.write(gzip.compress(warc_bytes(r), LEVEL, mtime=0)) or 0
                        records += r.kind != "warcinfo"
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return pages.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), "refers_url").mapInArrow(write, "path string, records long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (identifiers as text), read from the files of a manifest; digests are checked."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as f:
                    for r in read_warc(f):
                        if r.kind == "warcinfo":
                            continue
                        payload, (http, body) = r.headers["WARC-Payload-Digest"].removeprefix("sha256:"), split_http(r.block)
                        size = int(http_field(http, "Content-Length"))  # also of the payload that a revisit leaves out
                        if r.kind == "response":
                            if len(body) != size or digest(body) != payload:
                                raise ValueError(f"another payload than {r.headers['WARC-Record-ID']} had")
                        rows.append((_id_in(http_field(http, "X-Page-Id")), size, payload, r.kind, _id_in(r.headers.get(REFERS_TO_PAGE))))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    n = max(1, manifest.count())
    spread = manifest.select("path").repartition(n) if n > 1 else manifest.select("path")
    return spread.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = work.path("archives")
    back = read_archives(work.table(write_archives(with_originals(spread(pages)), folder), "manifest"), folder)
    kind = dict(pages.dtypes)["page_id"]
    return back.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(encode(coalesce(html, ''))) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN octet_length(body) >= {REVISIT_BYTES} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(body) >= {REVISIT_BYTES} AND first <> page_id THEN first END AS refers_to
FROM f
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": ORACLE}
