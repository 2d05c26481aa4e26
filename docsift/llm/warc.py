"""Legacy ARC archives to WARC, written and read back.

An ARC file is a version block followed by records, each a header line of fields in the
order that its version declares, then as many bytes as the line says, then a line end.
:func:`parse_arc` reads versions 1 and 2 by declared lengths alone, so a payload may hold
anything. :func:`to_warc` synthesises what ARC lacks: a record identifier (a name-based
UUID of URL, date and digest, hence the same on every run), an ISO 8601 date, a record
type and a base32 SHA-1 digest of the payload.

Among records of equal payloads of at least ``least`` bytes, the one with the largest key
is the response and the others are revisits that refer to it. Only digests are compared,
and only their maxima, combined where rows are read; the payloads stay in place.

Archives are written with Spark's text writer (a record is UTF-8 text ending in two line
ends) to the shared folder, and read back as binary files, record by record.

Defined results: null html counts as empty; a null URL is written as an empty address; a
page with a null key is always a response; rows that repeat key and payload are alike, all
responses or all revisits; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.scratch import new_path, written

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of a record's header line by ARC version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
#: Bytes that an archive should have at most where pages are of about one length.
FILE_BYTES = 16 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # for URLs, RFC 4122


class ArcError(ValueError):
    """A record that its declared fields or length do not fit."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    body: bytes
    version: int
    fields: dict[str, str] = field(default_factory=dict)


def arc_date(text: str) -> str:
    """ARC's digits (to the second, or fewer) as ISO 8601."""
    if not re.fullmatch(r"[0-9]{4,14}", text):
        raise ArcError(f"not an ARC date: {text[:20]!r}")
    full = text + "00000101000000"[len(text) :]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError as wrong:
        raise ArcError(f"not an ARC date: {text!r}") from wrong


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file with its version block."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    declared = f"{version} 0 docsift\n{names[version]}\n".encode()
    head = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "19960101000000", "type": "text/plain", "code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name}
    out = bytearray(_arc_line(head, version, len(declared)) + declared + b"\n")
    for r in records:
        values = {"code": "200", "checksum": "-", "location": "-", "offset": str(len(out)), "filename": name, **r.fields}
        values |= {"url": r.url, "ip": r.ip, "date": r.date, "type": r.type}
        out += _arc_line(values, version, len(r.body)) + r.body + b"\n"
    return bytes(out)


def _arc_line(values: dict[str, str], version: int, length: int) -> bytes:
    return " ".join([*(values[x] for x in ARC_FIELDS[version][:-1]), str(length)]).encode() + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file; the version block says how to read their header lines."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ArcError("a header line does not end")
        parts = data[at:stop].decode("utf-8").split(" ")
        if not version:
            if not parts[0].startswith("filedesc://") or len(parts) not in (5, 10):
                raise ArcError("the file does not start with a version block")
            length = _length(parts[-1])
            block = data[stop + 1 : stop + 1 + length]
            declared = block.split(b" ", 1)[0]
            if declared not in (b"1", b"2") or len(ARC_FIELDS[int(declared)]) != len(parts):
                raise ArcError("unknown ARC version")
            version = int(declared)
        else:
            names = ARC_FIELDS[version]
            if len(parts) != len(names):
                raise ArcError(f"{len(parts)} fields in a header line of version {version}")
            values = dict(zip(names, parts, strict=True))
            length = _length(values.pop("length"))
            body = data[stop + 1 : stop + 1 + length]
            if len(body) != length:
                raise ArcError("a record is shorter than declared")
            yield ArcRecord(values.pop("url"), values.pop("ip"), values.pop("date"), values.pop("type"), body, version, values)
        at = stop + 1 + length + 1


def _length(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise ArcError(f"not a length: {text[:20]!r}")
    return int(text)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload of an ARC record's bytes."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    head, blank, payload = body.partition(b"\r\n\r\n")
    return (head + blank, payload) if blank else (body, b"")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(url: str, date: str, payload_digest: str, key: str = "") -> str:
    """The same for the same capture; ``key`` tells captures apart that agree in all the rest."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(filter(None, (url, date, payload_digest, key))))}>"


def to_warc(record: ArcRecord, refers_to: tuple[str, str, str] | None = None, extra: dict[str, str] | None = None, key: str = "") -> bytes:
    """A WARC record; a revisit of (record id, URL, date) if that is given. ``key`` is of its id, see :func:`record_id`."""
    head, payload = split_http(record.body)
    date, said = arc_date(record.date), digest(payload)
    block = head if refers_to else head + payload
    kind = "revisit" if refers_to else "response" if head else "resource"
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(record.url, date, said, key)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha1:{said}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to[0]}", f"WARC-Refers-To-Target-URI: {refers_to[1]}", f"WARC-Refers-To-Date: {refers_to[2]}"]
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else record.type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        lines = data[at:stop].decode("utf-8").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = stop + 4
        end = start + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield fields, data[start:end]
        at = end + 4


def _uri(url: str | None) -> str:
    """A URL as a header field can hold it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _key(value: int | None) -> str:
    return "-" if value is None else str(value)


CAPTURED = "20200101000000"


def _convert(version: int):
    """Pages to ARC and from there to WARC; the text writer adds each record's last line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, html, best, best_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                arc = write_arc([ArcRecord(_uri(url), "0.0.0.0", CAPTURED, "text/html", head + payload, version)], version)
                for record in parse_arc(arc):
                    refers, extra = None, {"WARC-Page-Key": _key(page_id)}
                    if best is not None:
                        date = arc_date(record.date)
                        refers = (record_id(_uri(best_url), date, digest(payload), _key(best)), _uri(best_url), date)
                        extra["WARC-Refers-To-Page-Key"] = str(best)
                    out.append(to_warc(record, refers, extra, _key(page_id))[:-4].decode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse_warc(content.as_buffer().to_pybytes()):
                head, payload = split_http(block)
                kind = fields["warc-type"]
                said = fields["warc-payload-digest"].removeprefix("sha1:")
                declared = int(re.search(rb"Content-Length: ([0-9]+)", head)[1])
                if kind == "response" and (len(payload) != declared or digest(payload) != said):
                    raise ValueError("a payload is not what its record declares")
                key, refers = fields["warc-page-key"], fields.get("warc-refers-to-page-key")
                rows.append((None if key == "-" else int(key), declared, said, kind, None if refers is None else int(refers), fields["warc-target-uri"], fields["warc-record-id"], fields["warc-date"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], RECORD.replace(" long", "").replace(" string", "").split(", "))


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, date string"


def write_archives(pages: DataFrame, path: str, least: int = 0, version: int = 1) -> None:
    """One WARC record for each row (page_id, url, html) as uncompressed files below ``path``.

    Equal payloads of ``least`` bytes or more are stored once.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(html)).alias("sha"), F.octet_length(html).alias("size"))
    mean = keyed.agg(F.avg("size")).first()[0] or 0
    large = keyed.filter(F.col("size") >= least).select("page_id", "sha", "url")
    seen = large.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("best")).filter("n > 1 AND best IS NOT NULL")
    rivals = large.join(seen.select("sha", "best"), "sha")
    stored = rivals.filter("page_id = best").groupBy("sha").agg(F.min("url").alias("best_url"))
    revisits = rivals.filter("page_id < best").select("page_id", "sha", "best").distinct()
    links = written(revisits.join(stored, "sha"), "warc-links")
    linked = keyed.filter(F.col("size") >= least).join(links, ["page_id", "sha"], "left")
    small = keyed.filter(F.col("size") < least).select("*", F.lit(None).cast("long").alias("best"), F.lit(None).cast("string").alias("best_url"))
    if least > 0:
        linked = linked.unionByName(small)
    records = linked.select("page_id", "url", "html", "best", "best_url").mapInArrow(_convert(version), "value string")
    per_file = max(1, int(FILE_BYTES / (mean + 1000)))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``, in the columns of ``RECORD``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
    return files.select("content").mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame, least: int = 0, version: int = 1) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least, version)
    return read_archives(pages.sparkSession, path)
