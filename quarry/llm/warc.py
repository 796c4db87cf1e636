"""WARC archives: writing pages as records, and reading them back with segments reassembled.

A record's HTTP response has chunked transfer framing. A record whose block is longer than `segment_bytes` is written as
a first segment and continuation records. Reading groups the continuations by their origin identifier, orders them by
segment number, verifies that the numbers have no gap and the lengths add up to the declared total, then decodes the
chunked framing and verifies the payload's digest.

Archives are written by Spark's own text sink (the line separator is the record's last CRLF), so they reach every store
that Spark writes, and a lost executor repeats its files only. The number of records in a file is bounded, and so is the
memory of the task that reads it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, table_path, written

CRLF = b"\r\n"
#: Bytes of a record's block beyond which it is segmented, bytes of an HTTP chunk, records in a file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16_384, 4_096, 1_024

RECORD = "record_id string, record_type string, page_id long, refers_to string, declared_digest string, segment int, total_length long, payload_bytes long, payload_digest string, complete boolean, block binary"
LOGICAL = "record_id string, record_type string, page_id long, refers_to string, payload_bytes long, payload_digest string, complete boolean"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in HTTP/1.1 chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes:
    """The payload in chunked framing; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is shorter than its size")
        parts.append(body[at : at + size])
        at += size + 2


def digest32(payload: bytes) -> str:
    """A payload's SHA-1 in base 32, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response block, without its chunked framing; ValueError if it is broken."""
    head, gap, body = block.partition(CRLF + CRLF)
    if not gap:
        raise ValueError("an HTTP response without an end of its headers")
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def base32_of_hex(hexed: Column) -> Column:
    """40 hexadecimal digits as 32 digits of base 32, by built-in functions."""
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def head(pairs: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None) + "\r\n").encode()


def decided(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages with their digest and, where another page holds the same payload, the page that is its response.

    Of records with equal payloads of at least min_revisit_bytes, that with the smallest page_id is the response. Owners
    are found by an aggregate with map-side combine over digests, and joined back by a sort-merge join that adaptive
    execution splits where one payload is very common. Rows that repeat the owner's page_id and payload are responses
    too. A record's identifier holds the partition that its row is read in, so that copies of one row, however many, are
    not one group when their segments are put together; pages must come in the same partitions each time they are read,
    as files do. Null page_ids never own a payload, unless all are null: then all are responses.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    page = page.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    page = page.withColumn("record_id", F.md5(F.encode(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", "url", F.spark_partition_id().cast("string")), "UTF-8")))
    owners = (
        page.filter(F.col("size") >= min_revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("owner"), F.count("*").alias("n"))
        .filter("n > 1 and owner is not null")
        .select(F.col("digest").alias("d"), F.col("size").alias("s"), "owner")
    )
    joined = page.join(owners, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    own = F.col("owner").isNull() | F.col("owner.page_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", base32_of_hex(F.col("digest")).alias("digest"), "record_id", F.when(~own, F.col("owner.record_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one response or revisit record per page into gzipped WARC files under `path`.

    Pages need page_id, url and html; other columns are not read. A null html is an empty payload, a null url an empty
    target. A revisit has the response's headers and digest, but no payload.
    """

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                revisit = r["refers_to"] is not None
                urn = f"<urn:uuid:{r['record_id']}>"
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                block = http if revisit else http + chunked(r["payload"], chunk_bytes)
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                for n, part in enumerate(parts, 1):
                    last = n == len(parts) > 1
                    pairs = [
                        ("WARC-Type", "continuation" if n > 1 else "revisit" if revisit else "response"),
                        ("WARC-Record-ID", urn if n == 1 else f"<urn:uuid:{hashlib.md5(f'{urn}{n}'.encode()).hexdigest()}>"),
                        ("WARC-Date", date),
                        ("WARC-Target-URI", quote(r["url"], safe=":/?#[]@!$&'()*+,;=%~-._")),
                        ("WARC-Segment-Number", n if len(parts) > 1 else None),
                        ("WARC-Segment-Origin-ID", urn if n > 1 else None),
                        ("WARC-Segment-Total-Length", len(block) if last else None),
                    ]
                    if n == 1:
                        pairs += [
                            ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
                            ("WARC-Refers-To", f"<urn:uuid:{r['refers_to']}>" if revisit else None),
                            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
                            ("X-Page-Id", r["page_id"]),
                            ("Content-Type", "application/http; msgtype=response"),
                        ]
                    out.append(head([*pairs, ("Content-Length", len(part))]) + part + CRLF)
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    small_batches(pages.sparkSession)
    rows = decided(pages, min_revisit_bytes).mapInArrow(records, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parsed(archive: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an uncompressed archive, read by their Content-Length, one in memory at a time."""
    while line := archive.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields: dict[str, str] = {}
        while (line := archive.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = archive.read(int(fields["content-length"]))
        urn = lambda k: fields[k].removeprefix("<urn:uuid:").removesuffix(">") if k in fields else None  # noqa: B023, E731
        whole = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
        yield {
            "record_id": urn("warc-segment-origin-id") or urn("warc-record-id"),
            "record_type": fields["warc-type"],
            "page_id": whole("x-page-id"),
            "refers_to": urn("warc-refers-to"),
            "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
            "segment": whole("warc-segment-number"),
            "total_length": whole("warc-segment-total-length"),
            "block": block,
        }


def opened(r: dict, block: bytes) -> dict:
    """A response record with its payload's length and digest, and whether all that it declares holds."""
    if r["record_type"] != "response":
        return r | {"payload_bytes": None, "payload_digest": r["declared_digest"], "complete": True}
    try:
        payload = http_payload(block)
    except ValueError:
        return r | {"payload_bytes": None, "payload_digest": None, "complete": False}
    found = digest32(payload)
    return r | {"payload_bytes": len(payload), "payload_digest": found, "complete": r["complete"] and found == r["declared_digest"]}


def reassembled(segments: list[dict]) -> list[dict]:
    """The logical records of all records with one origin identifier.

    A record in one piece stands for itself. Segments are ordered by number; identical copies of a segment count once
    for each copy of the record. A gap, segments that differ under one number, no last segment or a wrong total length
    give one record with complete false and no payload.
    """
    whole = [r for r in segments if r["segment"] is None]
    rest = [r for r in segments if r["segment"] is not None]
    if not rest:
        return whole
    by: dict[int, list[dict]] = {}
    for r in rest:
        by.setdefault(r["segment"], []).append(r)
    first = by.get(1, rest)[0] | {"complete": True}
    order = sorted(by)
    block = b"".join(by[n][0]["block"] for n in order)
    sound = order == list(range(1, len(order) + 1)) and all(len({x["block"] for x in v}) == 1 for v in by.values()) and by[order[-1]][0]["total_length"] == len(block)
    if not sound:
        return [*whole, first | {"payload_bytes": None, "payload_digest": None, "complete": False}]
    return whole + [opened(first, block)] * min(map(len, by.values()))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Logical records of the archives under `path`: LOGICAL's columns, one row for each response or revisit.

    Records in one piece are decoded where their file is read; only segments travel with their blocks, grouped by origin
    identifier, so a group is no larger than one record. Copies of one record (repeated rows) stay apart.
    """
    small_batches(spark)
    names, logical = [c.split()[0] for c in RECORD.split(", ")], [c.split()[0] for c in LOGICAL.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())))):
                    rows.append(opened(r | {"complete": True}, r["block"]) | {"block": None} if r["segment"] is None else r)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, kept)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kept)

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for group in batch.column(0).to_pylist() for r in reassembled(group)], result)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    kept = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in RECORD.split(", "))])
    result = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in LOGICAL.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = files.mapInArrow(read, RECORD)
    grouped = records.groupBy("record_id").agg(F.collect_list(F.struct(*names)).alias("records")).select("records")
    return grouped.mapInArrow(assemble, LOGICAL).select(*logical)


def resolved(records: DataFrame) -> DataFrame:
    """Records with each revisit's payload length and page taken from the response that it refers to.

    `records` is read twice: a written table. The responses are one row for each record_id, so the join adds no rows; a
    response that very many revisits refer to is split by adaptive execution.
    """
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").select("record_id", "record_type", "page_id", F.col("refers_to").alias("target"))
    targets = responses.groupBy(F.col("record_id").alias("target")).agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"), F.first("complete").alias("complete"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.join(targets, "target", "left").select(columns))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, reads them back and returns what they hold, by page."""
    path = table_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(written(read_archives(spark, path), "warc-records"))


#: The expected rows; DuckDB lacks base 32, so hexadecimal digits become bits and bits become letters.
SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hexed FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, hexed, min(page_id) OVER (PARTITION BY hexed) AS owner FROM p
), letters AS (
    SELECT hexed, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hexed, 1 + 10 * (i // 8), 10))::BIGINT >> (5 * (7 - i % 8))) & 31)::INT, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest
    FROM (SELECT DISTINCT hexed FROM d)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN owner <> page_id THEN owner END AS refers_to, TRUE AS complete
FROM d JOIN letters USING (hexed)
"""
