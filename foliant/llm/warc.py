"""WARC archives: writing captures of pages, and assembling the records of each capture again.

A capture is three records: a response (or a revisit of an earlier equal payload), the request, and a metadata record;
the last two name the first in WARC-Concurrent-To.  Archives are written by Spark's text writer, whose line separator
is WARC's record separator, so that any file system Spark knows will do and lost tasks are written again; each file
holds one gzip-compressed segment of bounded size.  Reading goes by Content-Length alone, so payloads may hold anything.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialise

SPACE = uuid.UUID("6f0d3f4e-8a51-5c0e-9d3c-1b7f5f1a2c34")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored again.
MIN_REVISIT_BYTES = 100
SEGMENT_BYTES = 32 << 20
CAPTURED = "1970-01-01T00:00:00Z"
SEPARATOR = "\r\n\r\n"

RECORD = (
    "record_id string, type string, concurrent_to string, refers_to_record string, target_uri string, captured string, "
    "payload_digest string, payload_bytes long, page_id long, payload binary"
)


def _record_id(page_id: int | None, ordinal: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{ordinal}/{kind}')}>"


def _record(kind: str, record_id: str, block: str, **headers: str | None) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block.encode())}", "", block])


def _uri(url: str | None) -> str | None:
    """A header can't hold line ends; a null or empty URL is left out."""
    return "".join(url.split()) or None if url else None


def _capture(page_id, ordinal, url, html, digest, size, first_id, first_ordinal, captured) -> str:
    """The three records of one capture, each followed by the separator but for the last."""
    own = _record_id(page_id, ordinal, "response")
    first = (page_id, ordinal) == (first_id, first_ordinal)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{SEPARATOR}"
    shared = {"WARC_Date": captured, "WARC_Target_URI": _uri(url)}
    main = {**shared, "WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http; msgtype=response"}
    if not first:
        main |= {"WARC_Refers_To": _record_id(first_id, first_ordinal, "response"), "WARC_Profile": REVISIT_PROFILE}
    beside = {**shared, "WARC_Concurrent_To": own}
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    return SEPARATOR.join(
        [
            _record("response" if first else "revisit", own, http + html if first else http, **main),
            _record("request", _record_id(page_id, ordinal, "request"), f"GET {_uri(url) or '/'} HTTP/1.1{SEPARATOR}", **beside, Content_Type="application/http; msgtype=request"),
            _record("metadata", _record_id(page_id, ordinal, "metadata"), fields, **beside, Content_Type="application/warc-fields"),
        ]
    )


def _segments(captured: str, limit: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_capture(*row, captured))
                size += len(held[-1])
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)])], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)])], names=["value"])

    return segments


def write_warc(pages: DataFrame, path: str, captured: str = CAPTURED, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a capture of every row of ``pages`` (``page_id``, ``url``, ``html``; others are ignored) into ``path``.

    Of the rows with one payload of at least ``MIN_REVISIT_BYTES`` bytes, the one with the smallest page_id is a
    response and the others revisit it; among rows repeated under that page_id the first read is the response.  Rows
    without page_id come last in that order.  A null html is an empty payload; a null url leaves out the target URI.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    # Numbers tell rows of one page_id apart. They must stay the same when a plan is run again, so rows are written with
    # them where there are such rows; else the page_id is enough.
    if pages.groupBy("page_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("ordinal", F.lit(0).cast("long"))
    else:
        rows = materialise(rows.withColumn("ordinal", F.monotonically_increasing_id()), "warc-pages", compression="zstd")
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "ordinal")
    heads = rows.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min(place).alias("head"), F.count("*").alias("n"))
    # Written first, so that the planner knows its size and shuffles the payloads only if it is large.
    heads = materialise(heads.where("n > 1").select("digest", "head"), "warc-heads")
    head = lambda name: F.when(F.col("head").isNull(), F.col(name)).otherwise(F.col(f"head.{name}"))
    placed = rows.join(heads, "digest", "left").select(
        "page_id", "ordinal", "url", "html", "digest", "size", head("page_id").alias("first_id"), head("ordinal").alias("first_ordinal")
    )
    segments = placed.mapInArrow(_segments(captured, segment_bytes), "value string")
    segments.write.options(lineSep=SEPARATOR, maxRecordsPerFile=1, compression="gzip").text(path)


def parse_warc(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    data, at = bytes(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        yield headers, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record ends short of byte {at}")
        at += 4


def _records(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = {"payload_bytes": pa.int64(), "page_id": pa.int64(), "payload": pa.binary()}

    def row(headers: dict[str, str], block: bytes) -> list:
        kind, payload, size, digest, page = headers["warc-type"], None, None, None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if headers["warc-payload-digest"] != f"sha256:{digest}":
                    raise ValueError(f"the payload of {headers['warc-record-id']} does not match its digest")
        elif kind == "metadata":
            page = next((int(x.removeprefix("page-id: ")) for x in block.decode().split("\r\n") if x.startswith("page-id: ")), None)
        return [headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"), digest, size, page, payload if with_payload and kind == "response" else None]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[list]) -> pa.RecordBatch:
            columns = [pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_warc(gzip.decompress(content.as_buffer())):
                    rows.append(row(headers, block))
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return records


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``path``; digests of responses are computed from their payloads.

    A file is one segment, and a task is dealt files up to ``spark.sql.files.maxPartitionBytes``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_records(with_payload), RECORD)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit, with the request and metadata concurrent to it.

    ``page_id, record_type, target_uri, payload_digest, payload_bytes, refers_to``, then the structs ``response``,
    ``request`` and ``metadata`` (null where an archive lacks the record).  A revisit takes digest and size of the
    payload from the response it refers to; ``refers_to`` is that response's page_id.
    """
    own = records.where(F.col("type").isin("response", "revisit"))
    response = F.struct("record_id", "captured", "refers_to_record", "payload")
    own = own.select("record_id", "type", "target_uri", "refers_to_record", "payload_digest", "payload_bytes", response.alias("response"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("record_id"), "target_uri").alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("record_id"), "page_id").alias("metadata"))
    whole = own.join(request, "record_id", "left").join(metadata, "record_id", "left")
    heads = whole.where("type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("metadata.page_id").alias("refers_to"))
    revisits = whole.where("type = 'revisit'").join(heads, "refers_to_record", "left")
    columns = ["metadata.page_id", "type AS record_type", "target_uri"]
    nested = ["refers_to", "response", "request", "metadata"]
    first = whole.where("type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return first.selectExpr(*columns, "payload_digest", "payload_bytes", *nested).unionByName(
        revisits.selectExpr(*columns, "d AS payload_digest", "b AS payload_bytes", *nested)
    )
