"""Legacy ARC archives: writing, parsing by version, and conversion to WARC.

An ARC file opens with a version block, whose record line starts with `filedesc://` and whose body names
the version in its first line and the fields of all record lines in its second. Version 1 has
`URL IP-address Archive-date Content-type Archive-length`, version 2 adds result code, checksum,
location, offset and file name between type and length. A record is its line, the declared number of
bytes, and a line feed. Records are found by declared lengths alone, so payloads may hold anything.

Conversion makes from each ARC record a WARC/1.0 record: WARC-Record-ID is the version-5 UUID of what
identifies the capture, WARC-Date the 14-digit date in ISO form, WARC-Type `response`, or `revisit`
for all but one record of equal payloads, and digests are base-32 SHA-1. The response of equal
payloads is that of the largest page_id.

Files are written by Spark's text writer (it appends the line feed of ARC and, set so, the blank
lines of WARC), gzip-compressed, and read by its binary reader, all in the shared folder. One ARC file is one
input split of the table, so its size is bounded by spark.sql.files.maxPartitionBytes. A WARC file is cut
after FILE_CHUNKS chunks of records, of CHUNK bytes or one longer record each. A file is one gzip member:
Spark's writer puts a separator after each value, so records can't be members of their own.

Defined results: a null html is an empty payload. Very long payloads are written, and read, whole. A null url is written as `about:blank`; white space in
urls is percent-encoded. Rows that repeat page_id and payload of the response are responses too. A
null page_id stays null and only becomes a response if no equal payload has an id. Only page_id, url
and html are read. An empty table gives archives without records and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusops.llm.common import shared_dir, stored, table

# Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "20240101000000"
#: Bytes of records in a chunk, and chunks in a WARC file.
CHUNK, FILE_CHUNKS = 4_000_000, 64

META = "page_id long, url string, ip string, date string, kind string, payload_bytes long, payload_digest string, record_id string"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    return head.encode() + payload


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes with the blank line, payload."""
    end = block.index(b"\r\n\r\n") + 4
    fields = dict(x.split(": ", 1) for x in block[: end - 4].decode().split("\r\n")[1:])
    return fields, block[:end], block[end:]


# --- ARC --------------------------------------------------------------------------------------------


def arc_line(version: int, url: str, ip: str, date: str, kind: str, body: bytes, name: str) -> bytes:
    more = {1: [], 2: ["200", sha1(body), "-", "-", name]}[version]
    return " ".join([url, ip, date, kind, *more, str(len(body))]).encode() + b"\n"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 corpus\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", DATE, "text/plain", body, name) + body


def arc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the record line, body) of each record after the version block."""
    line = stream.readline()
    if not line.strip():
        return
    if not line.startswith(b"filedesc://"):
        raise ValueError("an ARC file starts with filedesc://")
    described = stream.read(int(line.rsplit(b" ", 1)[1])).split(b"\n")
    version, names = int(described[0].split(b" ")[0]), described[1].decode().split(" ")
    if names != ARC_FIELDS.get(version):
        raise ValueError(f"unknown ARC version {version} or fields {names}")
    while line := stream.readline():
        if line == b"\n":  # what ends the record before
            continue
        values = line.decode().rstrip("\n").split(" ")
        if len(values) != len(names):
            raise ValueError(f"{len(names)} fields expected: {line[:200]!r}")
        fields = dict(zip(names, values, strict=True))
        size = int(fields["Archive-length"])
        body = stream.read(size)
        if len(body) != size:
            raise ValueError(f"the record of {fields['URL']} is cut off")
        yield fields, body


def write_arc(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) as ARC files; those of odd partitions have version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = None
        for batch in batches:
            out = []
            for page_id, url, html, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if version is None:
                    version, name = 1 + part % 2, f"part-{part}.arc"
                    out.append(arc_version_block(version, name))
                body = http_block(page_id, (html or "").encode())
                url = re.sub(r"\s", lambda x: "".join(f"%{b:02X}" for b in x[0].encode()), url or "about:blank") or "about:blank"
                out.append(arc_line(version, url, "0.0.0.0", DATE, "text/html", body, name) + body)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.spark_partition_id().alias("part"))
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").text(path)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """META and, if wanted, the HTTP block of every record of the ARC files in path."""
    schema = META + (", block binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, body in arc_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    http, _, payload = split_http(body)
                    digest, page_id = sha1(payload), int(http["X-Page-Id"]) if http["X-Page-Id"] else None
                    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join([fields['URL'], fields['Archive-date'], str(page_id), digest]))}>"
                    rows.append((page_id, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], len(payload), digest, record_id, body)[: 9 if payloads else 8])
                    held += len(body)
                    if held > 8_000_000:
                        yield arrow(rows, payloads)
                        rows, held = [], 0
                yield arrow(rows, payloads)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def arrow(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * payloads]
    names = [x.split(" ")[0] for x in META.split(", ")] + ["block"] * payloads
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


# --- WARC -------------------------------------------------------------------------------------------

RECORD_END = b"\r\n\r\n"


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n").encode() + block


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line == b"\r\n":  # what ends the record before
            continue
        if line.rstrip() != b"WARC/1.0":
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, value = line.decode().rstrip("\r\n").split(": ", 1)
            fields[name] = value
        yield fields, stream.read(int(fields["Content-Length"]))


def convert(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0, chunk: int = CHUNK, file_chunks: int = FILE_CHUNKS) -> None:
    """WARC files in warc from the ARC files in arc. Payloads of fewer than least_bytes bytes are never
    revisits. What decides is gathered per digest first, combined in each task before it is shuffled; a
    hot digest's records then meet that one row in a join whose large partitions Spark splits."""
    first = F.struct(F.col("page_id").isNotNull(), "page_id", "url", "date", "record_id")
    # the digest and length, and not the payload, are compared
    best = read_arc(spark, arc, payloads=False).where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(first).alias("first"))
    best = stored(best.select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "first.page_id", "first.url", "first.date", "first.record_id").toDF("_digest", "_bytes", "_page_id", "_url", "_date", "_record_id"))
    rows = read_arc(spark, arc)
    joined = rows.join(best, (rows["payload_digest"] == best["_digest"]) & (rows["payload_bytes"] == best["_bytes"]), "left")
    revisit = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_page_id"))

    info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, warc)}>"), ("WARC-Date", iso(DATE)), ("Content-Type", "application/warc-fields")], b"software: corpusops\r\nformat: WARC File Format 1.0\r\n")

    def record(r: dict) -> bytes:
        block, kind = r["block"], "revisit" if r["revisit"] else "response"
        fields = [("WARC-Type", kind), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["url"]), ("WARC-Date", iso(r["date"])), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("Content-Type", "application/http; msgtype=response")]
        if r["revisit"]:
            block = split_http(block)[1]
            fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", r["_record_id"]), ("WARC-Refers-To-Target-URI", r["_url"]), ("WARC-Refers-To-Date", iso(r["_date"])), ("X-Refers-To-Page-Id", "" if r["_page_id"] is None else str(r["_page_id"]))]
        return warc_record([*fields, ("WARC-Block-Digest", f"sha1:{sha1(block)}")], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of records; the first of each file starts with the record that describes the file."""
        held, size, chunks = [info], 0, 0
        value = lambda: pa.RecordBatch.from_arrays([pa.array([RECORD_END.join(held)], pa.binary())], ["value"])
        for batch in batches:
            for r in batch.to_pylist():
                data = record(r)
                if size and size + len(data) > chunk:
                    yield value()
                    chunks += 1
                    held, size = [info] if chunks % file_chunks == 0 else [], 0
                held.append(data)
                size += len(data)
        if size:
            yield value()

    records = joined.select("page_id", "url", "ip", "date", "payload_digest", "record_id", "block", revisit.alias("revisit"), "_page_id", "_url", "_date", "_record_id")
    values = records.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    values.write.option("compression", "gzip").option("lineSep", RECORD_END.decode()).option("maxRecordsPerFile", file_chunks).text(warc)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date) of every capture
    in the WARC files of path; digests of responses and blocks are computed anew and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = split_http(block)
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if fields["WARC-Type"] == "response" and (sha1(payload) != digest or len(payload) != size):
                        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
                    to = fields.get("X-Refers-To-Page-Id")
                    rows.append((int(http["X-Page-Id"]) if http["X-Page-Id"] else None, size, digest, fields["WARC-Type"], int(to) if to else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as ARC archives, converted to WARC archives, read back."""
    arc, warc = shared_dir(spark), shared_dir(spark)
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Digests are written in base 32 from five hexadecimal digits, of 20 bits, at a time.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::BIGINT) AS fifths FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(fifths, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
