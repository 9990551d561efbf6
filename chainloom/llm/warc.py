"""Operator 6: WARC archives with revisit records, and a salvage reader.

Writing: a record for each row goes through Spark's text writer, so archives land on whatever store the path names.
The record's closing CRLF CRLF is one CRLF of its own and the writer's line separator.

Reading: archives come as binary files. A record has to have a version line, a header block, a sane Content-Length, the
closing CRLF CRLF and, where it carries a digest of its block, a matching SHA-256. When a check fails, the reader
searches for the next version line or gzip member that passes, goes on there, and logs the bytes between as quarantined.

Defined results: a null html is an empty payload; the response among equal payloads is the row with the smallest
page_id, and rows that repeat that page_id with that payload are responses too; a null page_id comes after all others, so
it revisits the smallest id of an equal payload, and is a response where there is none; a very long html is a record in an
archive of its own; an empty table gives no rows; other columns are ignored. The tables tell no time of a crawl: WARC-Date,
which a record must have, is a parameter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import Workspace

LEAST_REVISIT = 100  # bytes of a payload that is worth a revisit record
ROWS_PER_FILE = 2048
FILE_BYTES = 128 << 20  # payload bytes of an archive at most, or one row
OUT_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
BROADCAST_REVISITS = 200_000
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"

#: One row for each record, and one with kind "gap" for each quarantined stretch of bytes.
READ = "kind string, path string, at long, size long, reason string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def headers(record_type: str, date: str) -> list[tuple[str, str]]:
    """Header names and the SQL expressions of their values."""
    revisit = record_type == "revisit"
    return [
        ("WARC-Type", f"'{record_type}'"),
        ("WARC-Date", f"'{date}'"),
        ("WARC-Record-ID", "concat('<urn:page:', coalesce(cast(page_id as string), ''), '>')"),
        ("WARC-Target-URI", "regexp_replace(coalesce(url, ''), '[\\\\r\\\\n]', ' ')"),
        ("WARC-Payload-Digest", "concat('sha256:', digest)"),
        *([("WARC-Profile", "'http://netpreserve.org/warc/1.1/revisit/identical-payload-digest'"), ("WARC-Refers-To", "concat('<urn:page:', refers_to, '>')")] if revisit else []),
        ("Content-Type", "'text/html'"),
        ("Content-Length", "'0'" if revisit else "octet_length(payload)"),
    ]


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Archives under path, each payload of at least LEAST_REVISIT bytes once and then revisits of it.

    What is equal is found on digests and sizes alone. Revisits are few against pages: up to BROADCAST_REVISITS of them,
    which are counted, go to the pages; beyond, html moves to be joined by page_id.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    keys = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "refers_to")
    revisits = keys.join(firsts, "digest").filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to").select(F.col("page_id").alias("again"), F.col("digest").alias("of"), "refers_to").distinct()
    revisits = Workspace(pages.sparkSession, "revisits").table(revisits, "revisits")
    revisits = F.broadcast(revisits) if revisits.count() <= BROADCAST_REVISITS else revisits
    told = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("of")), "left")

    def record(kind: str) -> str:
        lines = ", ".join(f"'{name}: ', {value}, '\\r\\n'" for name, value in headers(kind, date))
        return f"concat('WARC/1.1\\r\\n', {lines}, '\\r\\n'{', payload' if kind == 'response' else ''}, '\\r\\n')"

    largest = rows.agg(F.max(F.octet_length("payload"))).first()[0] or 1
    per_file = max(1, min(ROWS_PER_FILE, FILE_BYTES // largest))
    value = F.when(F.col("refers_to").isNull(), F.expr(record("response"))).otherwise(F.expr(record("revisit")))
    told.select(value.alias("value")).write.mode("overwrite").option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).text(path)


class Record(NamedTuple):
    end: int
    headers: dict[str, str]
    block: bytes


def record_at(data: bytes, at: int) -> Record | str:
    """The record that starts at a byte, or why there is none."""
    if not (version := VERSION.match(data, at)):
        return "no version line"
    body = data.find(b"\r\n\r\n", version.end())
    if body < 0:
        return "no end of headers"
    found: dict[str, str] = {}
    for line in data[version.end() : body].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header line without a colon"
        found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", found.get("content-length", "")):
        return "no Content-Length"
    start, size = body + 4, int(found["content-length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        return "no CRLF CRLF after the block"
    block = data[start : start + size]
    said = found.get("warc-payload-digest", "")
    if found.get("warc-type") == "response" and said.startswith("sha256:") and hashlib.sha256(block).hexdigest() != said[7:]:
        return "the digest doesn't match"
    return Record(start + size + 4, found, block)


def member_at(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The inflated gzip member that starts at a byte, and where it ends; None if its checks fail."""
    inflate = zlib.decompressobj(wbits=31)
    try:
        out = inflate.decompress(memoryview(data)[at:])
    except zlib.error:
        return None
    return (out, len(data) - len(inflate.unused_data)) if inflate.eof else None


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(at, size, record) for each good record and (at, size, reason) for each gap, in order of bytes.

    Records of a gzip member have the member's place; a broken record inside a member is a gap of that place.
    """
    at = 0
    while at < len(data):
        why: Record | str = "neither a version line nor a gzip member"
        if data.startswith(GZIP, at):
            if member := member_at(data, at):
                for _, _, x in salvage(member[0]):
                    yield at, member[1] - at, x
                at = member[1]
                continue
            why = "a broken gzip member"
        elif data.startswith(b"WARC/", at):
            got = record_at(data, at)
            if isinstance(got, Record):
                yield at, got.end - at, got
                at = got.end
                continue
            why = got
        after = at + 1
        while True:  # the next place where a record or a member passes its checks
            places = [p for p in (data.find(b"WARC/1.", after), data.find(GZIP, after)) if p >= 0]
            if not places:
                after = len(data)
                break
            after = min(places)
            if isinstance(record_at(data, after), Record) if data[after] == 87 else member_at(data, after) is not None:
                break
            after += 1
        yield at, after - at, why
        at = after


def page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of READ for all archives under path. Payloads are those in the records; revisits have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for at, n, x in salvage(data):
                    if isinstance(x, str):
                        held.append(("gap", name, at, n, x, *[None] * 6))
                    else:
                        kind, said = x.headers.get("warc-type"), x.headers.get("warc-payload-digest", "")
                        block = x.block if kind != "revisit" else None
                        digest = said.removeprefix("sha256:") if block is None else hashlib.sha256(block).hexdigest()
                        held.append(("record", name, at, n, None, page_of(x.headers.get("warc-record-id")), kind, page_of(x.headers.get("warc-refers-to")), digest, None if block is None else len(block), block))
                        size += len(x.block)
                    if size >= OUT_BYTES or len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), work.path("archives"))
    columns = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    found = work.table(read_archives(spark, work.path("archives")).select("kind", *columns), "records")
    if gaps := found.filter("kind = 'gap'").count():  # what this query wrote itself has to be whole
        raise ValueError(f"{gaps} stretches of the archives can't be read")
    #: A revisit's size is that of the response it names; those responses have one row for each page_id.
    sizes = found.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("full"))
    of = (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("digest"))
    return found.join(sizes, of, "left").select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages
), d AS (
  SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d
"""
