"""Legacy archives: ARC files (versions 1 and 2) written, parsed by declared lengths, and converted to WARC.

All files are written and read by Spark in the shared folder. A record is a gzip member of its own, so that
it can be reached by its offset, and files are rolled by bytes. An ARC file starts with a version block that
names its fields; another one may follow at any record, so that files may be joined. The converter makes
record ids, timestamps, types and digests of WARC records; of equal payloads of LEAST bytes or more the record
with the largest source id is a response and the others are revisits of it.

Spark's text writer ends each row with a separator and starts a file anew after so many rows. Rows are gzip
members here: a member of less than 16 MB ends with a zero byte, its size's highest, which is left to the
separator; and a record that weighs more than one row is followed by empty members, which hold nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm.common import attach, bounded, drop_path, fresh_path, slices, table

LEAST = 1000
#: Bytes that weigh one row, and rows of a file: a file has at most about their product before compression, and one record.
UNIT, ROWS = 1 << 16, 2048
#: Bytes of payload after which a batch goes on.
BATCH = 4 << 20
#: Bytes of a gzip member at most: more is several members.
MEMBER, LEVEL = 15 << 20, 6

#: Fixed values of the format: the fields of a record's header line by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PRINTABLE = "".join(map(chr, range(33, 127)))
SCHEMA = "record_id string, type string, url string, ip string, date string, content_type string, source_id long, head binary, payload binary, payload_bytes long, payload_digest string"


def arc_header(version: int, url: str, date: str, kind: str, body: bytes, offset: int) -> str:
    more = f" 200 {hashlib.md5(body).hexdigest()} - {offset} pages.arc" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{more} {len(body)}"


def member(data: bytes) -> bytes:
    """The data as gzip, without the zero byte at its end."""
    return b"".join(gzip.compress(data[k : k + MEMBER], LEVEL, mtime=0) for k in range(0, max(1, len(data)), MEMBER))[:-1]


EMPTY = member(b"")


def padding(size: int, row: int, rows: int) -> list[bytes]:
    """What follows a record of so many bytes that made the number of rows `row`: empty members, to the file's end at most."""
    return [EMPTY] * min(size // UNIT, -row % rows)


def write_members(rows: DataFrame, path: str, count: int) -> None:
    """Files of the gzip members in the column value, `count` in each."""
    rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", count).option("lineSep", "\0").text(path)


def write_arc(pages: DataFrame, path: str, count: int = ROWS) -> None:
    """ARC files of pages (page_id, url, html): each is a version block and records, versions taking turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, offset, version = 0, 0, 1
        for batch in (part for whole in batches for part in slices(whole, 500, 8)):
            out: list[bytes] = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n % count == 0:
                    version = 1 + n // count % 2
                    body = f"{version} 0 pagegraph\n{FIELDS[version]}\n".encode()
                    block = arc_header(version, "filedesc://pages.arc", "20000101000000", "text/plain", body, 0).encode() + b"\n" + body + b"\n"
                    out.append(member(block))
                    offset, n = len(block), n + 1
                payload = (html or "").encode()
                source = "" if page_id is None else f"X-Source-Id: {page_id}\r\n"
                raw = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{source}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                at = datetime(2000, 1, 1, tzinfo=UTC) + timedelta(seconds=(page_id or 0) % 10**9)
                record = arc_header(version, quote(url or "about:blank", safe=PRINTABLE), f"{at:%Y%m%d%H%M%S}", "text/html", raw, offset).encode() + b"\n" + raw + b"\n"
                offset += len(record)
                out.append(member(record))
                pads = padding(len(record), n + 1, count)
                out += pads
                n += 1 + len(pads)
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    write_members(rows.mapInArrow(run, "value binary"), path, count)


def arc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, body) of each record; version blocks come first among them and set the fields."""
    names: list[str] | None = None
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        text = line.decode("utf-8", "replace")
        length = int(text.rsplit(" ", 1)[1])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError(f"archive ends within a record of {length} bytes")
        if text.startswith("filedesc://"):
            names = body.split(b"\n")[1].decode().lower().split()
        fields = names or FIELDS[2 if text.count(" ") >= 9 else 1].lower().split()
        yield dict(zip(fields, text.rsplit(" ", len(fields) - 1), strict=True)), body


def converted(fields: dict[str, str], body: bytes) -> tuple:
    """The columns of SCHEMA for an ARC record."""
    digits = (fields["archive-date"] + "19700101000000"[len(fields["archive-date"]) :])[:14]
    date = f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"
    url, kind, head, source = fields["url"], "resource", b"", None
    if url.startswith("filedesc://"):
        kind = "warcinfo"
    elif body.startswith(b"HTTP/"):
        kind = "response"
        cut = body.find(b"\r\n\r\n") + 4
        head, body = (body[:cut], body[cut:]) if cut >= 4 else (body, b"")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.lower() == b"x-source-id":
                source = int(value)
    digest = hashlib.sha1(body).hexdigest()
    name = hashlib.sha1("\n".join((url, date, str(source), digest)).encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>", kind, url, fields["ip-address"], date, fields["content-type"], source, head, body, len(body), digest


def response(row: tuple) -> bytes:
    """The WARC record of a converted record as it stands, whole."""
    record_id, kind, url, ip, date, content_type, _, head, payload, _, digest = row
    http = {"response": "application/http;msgtype=response", "warcinfo": "application/arc-version-block"}.get(kind, content_type)
    place = [] if kind == "warcinfo" else [("WARC-Target-URI", url), ("WARC-IP-Address", ip)]
    return warc_record(kind, record_id, date, place, digest, [], http, head + payload)


def revisit(whole: bytes, first: dict) -> bytes:
    """The WARC record of a response, given as its member, whose payload is that of the record `first`."""
    fields, block = next(warc_records(io.BytesIO(gzip.decompress(whole + b"\0"))))
    more = [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", first["record_id"]),
        ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"]), ("X-Refers-To-Source-Id", str(first["source_id"])),
    ]
    place = [("WARC-Target-URI", fields["warc-target-uri"]), ("WARC-IP-Address", fields["warc-ip-address"])]
    return warc_record("revisit", fields["warc-record-id"], fields["warc-date"], place, fields["warc-payload-digest"].removeprefix("sha1:"), more, fields["content-type"], block[: block.find(b"\r\n\r\n") + 4])


def warc_record(kind: str, record_id: str, date: str, place: list[tuple[str, str]], digest: str, more: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *place, ("WARC-Payload-Digest", f"sha1:{digest}"), *more,
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", content_type), ("Content-Length", str(len(block))),
    ]
    return "".join(["WARC/1.1\r\n", *[f"{name}: {value}\r\n" for name, value in fields], "\r\n"]).encode() + block + b"\r\n\r\n"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def opened(content: pa.Scalar) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)


def read_arc(spark: SparkSession, path: str, keep: str = "payload") -> DataFrame:
    """The converted records of all archives at a path, with `keep`: the payload, the member that is their WARC record, or '' for neither."""
    schema = f"{SCHEMA}, member binary"
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in arc_records(opened(content)):
                    row = converted(*record)
                    whole = member(response(row)) if keep == "member" else None
                    rows.append((*row[:7], row[7] if keep else None, row[8] if keep == "payload" else None, *row[9:], whole))
                    size += len(row[8])
                    if size >= BATCH or len(rows) >= 1000:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return read_files(spark, path).mapInArrow(run, schema)


def revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """For each digest of several payloads of `least` bytes or more: the record that the others revisit."""
    large = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= least))
    groups = large.groupBy("payload_digest").agg(F.count("*").alias("copies"), F.max(F.struct("source_id", "record_id", "url", "date")).alias("first"))
    return groups.where("copies > 1 and first.source_id is not null").select("payload_digest", "first")


def write_warc(records: DataFrame, first: DataFrame, path: str, least: int = LEAST, count: int = ROWS) -> None:
    """WARC files of converted records with their members; `first` from revisits()."""
    # Only what decides travels with the member: a revisit's fields are read from the member that it replaces.
    rows = attach(records.select("payload_digest", "record_id", "source_id", "type", "payload_bytes", "member"), first, ["payload_digest"], ["record_id"])
    own = (F.col("first.source_id") == F.col("source_id")) & (F.col("first.record_id") == F.col("record_id"))
    again = (F.col("type") == "response") & (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.coalesce(own, F.lit(False))
    rows = rows.select("member", "payload_bytes", F.when(F.coalesce(again, F.lit(False)), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in (part for whole in batches for part in slices(whole, 500, 8)):
            out: list[bytes] = []
            for whole, size, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(whole if x is None else member(revisit(whole, x)))
                pads = padding(size if x is None else 0, n + 1, count)
                out += pads
                n += 1 + len(pads)
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    write_members(rows.mapInArrow(run, "value binary"), path, count)


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, by declared length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        length = int(fields["content-length"])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError(f"archive ends within a record of {length} bytes")
        yield fields, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date, record_id of each page record; digests of blocks and payloads are checked."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for fields, body in warc_records(opened(content)):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    if fields["warc-block-digest"] != "sha1:" + hashlib.sha1(body).hexdigest():
                        raise ValueError(f"block digest of {fields['warc-record-id']} does not fit")
                    head, payload = body, b""
                    if fields["content-type"].startswith("application/http"):
                        cut = body.find(b"\r\n\r\n") + 4
                        head, payload = body[:cut], body[cut:]
                    http = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and digest != hashlib.sha1(payload).hexdigest():
                        raise ValueError(f"payload digest of {fields['warc-record-id']} does not fit")
                    page = int(http[b"x-source-id"]) if b"x-source-id" in http else None
                    refers = fields.get("x-refers-to-source-id")
                    rows.append((page, int(http[b"content-length"]), digest, fields["warc-type"], refers and int(refers), fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"]))
                    if len(rows) >= 1000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return read_files(spark, path).mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) through ARC archives, converted to WARC, and read back: a row per page.

    Null html: an empty payload. Null or empty url: about:blank; characters that a header line can't
    hold are percent-encoded. Null page_id: null, a revisit where the group has an id, never one
    that others revisit. Repeated rows: each has its record, and of those with the
    largest page_id of their group the ones that are alike in all are responses. Extra columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "op1-arc"), fresh_path(spark, "op1-warc")
    bounded(spark)
    write_arc(pages, arc)
    write_warc(read_arc(spark, arc, "member"), revisits(read_arc(spark, arc, "")), warc)
    drop_path(spark, arc)
    return read_warc(spark, warc)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM r
"""

QUERIES = {"op1_warc": op1_warc}
ORACLES = {"op1_warc": SQL}
