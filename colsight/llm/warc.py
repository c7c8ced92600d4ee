"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. The reader cuts archives into byte ranges. A task
scans its range for the gzip magic, accepts a place as a member only if a WARC header can be
decoded there, and owns the records that start inside its range, also when they end behind
it. After a member the scan goes on at its end, so bytes inside a member are never taken for
one, and a range that begins within a record skips to the next. A payload of binary data could
hold a stored copy of a whole member; text cannot, as the magic is not valid UTF-8.

Tasks read and write the archive folder as a file system that all of them share. A file gets a
name of its own in each attempt and counts only once its task has reported it, so a task that
is lost or runs twice leaves no record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared
from colsight.session import work_folder

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 18
HEADER_BYTES = 1 << 16
OUT_BYTES = 4 << 20
PREFIX = "urn:colsight:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, size bigint, records bigint"
RECORDS = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, "
    "refers_to string, payload binary, intact boolean"
)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit record without payload if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if uri is not None:
        # A line break inside a URI would end the field.
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (record_id, uri, payload, refers_to) as archives in ``folder``; returns the list of
    files (path, size, records), itself written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        out, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("record_id", "uri", "payload", "refers_to"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                member = record(*(x.as_py() for x in row))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, n))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{name}" for name, _, _ in done], pa.string()),
                pa.array([size for _, size, _ in done], pa.int64()),
                pa.array([n for _, _, n in done], pa.int64()),
            ],
            ["path", "size", "records"],
        )

    return shared.written(pages.select("record_id", "uri", "payload", "refers_to").mapInArrow(run, MANIFEST))


def _member(file, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``, or None if no WARC record begins there."""
    file.seek(at)
    inflate = zlib.decompressobj(31)
    parts, head = [], b""
    while not inflate.eof:
        data = file.read(READ_BYTES)
        if not data:
            if head.startswith(b"WARC/1.") and b"\r\n\r\n" in head:
                raise ValueError(f"the archive ends within the record at byte {at}")
            return None
        at += len(data)
        try:
            part = inflate.decompress(data)
        except zlib.error:
            if head.startswith(b"WARC/1.") and b"\r\n\r\n" in head:
                raise
            return None
        parts.append(part)
        if len(head) < HEADER_BYTES and b"\r\n\r\n" not in head:
            head += part[:HEADER_BYTES]
            if not b"WARC/1.".startswith(head[:7]) and not head.startswith(b"WARC/1."):
                return None
    if not head.startswith(b"WARC/1."):
        return None
    return b"".join(parts), at - len(inflate.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(content: bytes) -> tuple:
    """Row of RECORDS from an uncompressed record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    payload = body if kind == "response" else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(body) if kind == "response" else int(_fields(http).get("content-length", 0))
    bare = lambda x: x and x.strip("<>")
    return (
        bare(fields["warc-record-id"]), kind, fields.get("warc-target-uri"), digest, size, bare(fields.get("warc-refers-to")), payload,
        None if payload is None else base32_sha1(payload) == digest,
    )


def scan(file, start: int, stop: int) -> Iterator[tuple]:
    """Records that begin in ``start <= byte < stop``."""
    at = start
    while at < stop:
        file.seek(at)
        # Two bytes more, so that a magic across the end of the piece is seen.
        data = file.read(min(READ_BYTES, stop - at) + len(MAGIC) - 1)
        place = data.find(MAGIC)
        if place < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += place
        found = _member(file, at)
        if found is None:
            at += 1
        else:
            yield parse(found[0])
            at = found[1]


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the listed files (path, size), read in ranges of ``split_bytes``.

    Columns: record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to,
    payload (missing for revisits), intact (payload matches its digest). An archive that ends
    within a record is an error.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes).cast("bigint")))
    split = archives.filter("size > 0").select("path", "size", starts.alias("start"))
    split = split.select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("stop"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload", "intact"]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.bool_()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                files, place = _file_system(path)
                rows, size = [], 0
                with files.open_input_file(place) as file:
                    for row in scan(file, start, stop):
                        rows.append(row)
                        size += 200 + len(row[6] or b"")
                        if size > OUT_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return split.repartition(shared.partitions(archives.sparkSession)).mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write one record per row of (page_id, url, html) and read the archives back.

    Returns a row per input row: page_id, payload_bytes, payload_digest, record_type, refers_to.
    Of rows with equal html the one with the smallest page_id is a response, the others
    revisit it; html is taken in UTF-8, missing html as empty. Rows that repeat the smallest
    page_id are responses too. A missing page_id counts as larger than any other; rows
    without one are responses if their whole group has none. Other columns are not looked at.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("uri"), payload.alias("payload"))
    source = source.withColumn("digest", F.unhex(F.sha1("payload")))
    first = source.groupBy("digest").agg(F.min("page_id").alias("first"))
    urn = lambda c: F.concat(F.lit(PREFIX), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    rows = source.join(first, "digest").select(
        urn("page_id").alias("record_id"),
        "uri",
        "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), urn("first")).alias("refers_to"),
    )
    archives = write_archives(rows, work_folder(spark))
    number = lambda c: F.regexp_extract(c, r":(-?\d+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    return read_archives(archives).select(
        as_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        as_id("refers_to").alias("refers_to"),
    )


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages."""
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP10_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, size AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM d
"""
