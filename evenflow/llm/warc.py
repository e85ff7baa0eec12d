"""WARC archives: write web pages as request, response (or revisit) and metadata records, read archives back, and
assemble the records of one capture through their concurrent-to identifiers.

Archives are written by Spark's text writer: a record is one value, the blank lines that end a WARC record are the
line separator, and files are committed like any other Spark output. Records have no size limit but that of a Spark
string. Reading streams each archive through a decompressor and holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenflow.llm.store import stored

END = "\r\n\r\n"
CAPTURED = "2024-01-01T00:00:00Z"
BATCH_BYTES = 8 << 20

# Base 32 as Spark's conv() writes it and as RFC 4648 does: fixed alphabets.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 SHA-1 of a binary or string column."""
    digest = F.sha1(payload)
    chunks = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*chunks), CONV_DIGITS, RFC_DIGITS)


def _record_id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + " "), key))
    parts = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind, record_id: Column, block: Column, content_type: str, headers: list[tuple[str, Column]], date: str) -> Column:
    """A whole record; headers with a null value are left out."""
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = CAPTURED, records_per_file: int = 30_000) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8, a null html is empty. Of rows with equal payloads of at least
    ``min_revisit_bytes`` those with the smallest page_id (null last) are responses, the others revisits without a
    body. An empty table gives empty archives. Blanks and control characters of a url are percent-encoded in the target header; a null url has no header.
    The metadata block keeps page_id, url and payload size as JSON.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    first = stored(rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("first_id")))
    rows = rows.join(first, ["digest", "bytes"])
    revisit = (F.col("bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def own(page):
        return F.concat_ws(" ", F.coalesce(F.col(page).cast("string"), F.lit("-")), F.col("digest"))

    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    rows = rows.select(
        "*", uri.alias("uri"), revisit.alias("revisit"), _record_id("capture", own("page_id")).alias("id"),
        _record_id("capture", own("first_id")).alias("first"), _record_id("request", own("page_id")).alias("request_id"),
        _record_id("metadata", own("page_id")).alias("metadata_id"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    request = _record(
        F.lit("request"), F.col("request_id"),
        F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1" + END)),
        "application/http; msgtype=request", [("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("id"))], date)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    response = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("id"),
        F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("payload"))), "application/http; msgtype=response",
        [("WARC-Target-URI", F.col("uri")), ("WARC-Payload-Digest", digest),
         ("WARC-Refers-To", F.when(F.col("revisit"), F.col("first"))),
         ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))], date)
    notes = F.to_json(F.struct("page_id", "url", F.col("bytes").alias("payload_bytes")))
    metadata = _record(F.lit("metadata"), F.col("metadata_id"), notes, "application/json",
                       [("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("id"))], date)
    rows.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream:
    """Bytes of a gzip or plain archive, decompressed as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        chunk = self.data[self.at:self.at + (1 << 18)]
        self.at += len(chunk)
        if self.unzip is None:
            self.buffer += chunk
            return True
        self.buffer += self.unzip.decompress(chunk)
        while self.unzip.eof and (rest := self.unzip.unused_data):  # the next member
            self.unzip = zlib.decompressobj(31)
            self.buffer += self.unzip.decompress(rest)
        if self.unzip.eof:
            self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        begin = 0
        while (i := self.buffer.find(mark, begin)) < 0:
            begin = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[:i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        if len(self.buffer) < n:
            raise ValueError("an archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    stream = _Stream(data)
    while (head := stream.until(END.encode())) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != END.encode():
            raise ValueError("a record does not end where its length says")
        yield headers, block


RECORD = ("type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, header_digest string, "
          "payload_bytes long, payload_digest string, block binary")
RECORD_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``: columns ``RECORD``.

    payload_bytes and payload_digest describe the payload as read: of a response or request what follows the HTTP
    header, else the block. Without ``payload`` the blocks of responses are not returned.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for data in batch.column(0):
                for headers, block in records(data.as_buffer().to_pybytes()):
                    kind = headers.get("warc-type")
                    body = block.partition(END.encode())[2] if headers.get("content-type", "").startswith("application/http") else block
                    rows.append((
                        kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                        headers.get("warc-target-uri"),
                        headers.get("warc-date"), (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None, len(body),
                        base64.b32encode(hashlib.sha1(body).digest()).decode(), block if payload or kind != "response" else None))
                    held += len(rows[-1][-1] or b"") + 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD_ARROW, strict=True)], schema=RECORD_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD_ARROW, strict=True)], schema=RECORD_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def assemble_captures(rows: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, request, response, metadata``.

    Requests and metadata join the response or revisit that their concurrent-to identifier names. A part that is not
    there is null; of several records of one kind in a capture the one with the smallest id stays; a response that
    was written several times under one id gives as many rows.
    """
    anchor = F.col("type").isin("response", "revisit")
    key = F.when(anchor, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    fields = [F.col(c) for c in ("record_id", "type", "refers_to", "target_uri", "date", "header_digest", "payload_bytes", "payload_digest", "block")]

    def part(condition):
        return F.min(F.when(condition, F.struct(*fields)))

    grouped = rows.where(key.isNotNull()).groupBy(key.alias("capture_id")).agg(
        part(F.col("type") == "request").alias("request"), part(anchor).alias("response"), part(F.col("type") == "metadata").alias("metadata"),
        F.greatest(F.count(F.when(anchor, 1)), F.lit(1)).alias("times"))
    return grouped.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def capture_digests(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of assembled captures.

    A revisit takes size and page from the response that it refers to.
    """
    notes = F.from_json(F.col("metadata.block").cast("string"), "page_id long, url string, payload_bytes long")
    flat = captures.select(
        "capture_id", notes["page_id"].alias("page_id"), F.col("response.type").alias("record_type"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.refers_to").alias("named"))
    whole = flat.where("record_type = 'response'")
    kept = whole.groupBy(F.col("capture_id").alias("named")).agg(
        F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("full_bytes"), F.min("payload_digest").alias("full_digest"))
    again = flat.where("record_type = 'revisit'").join(kept, "named", "left")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to"))


def round_trip(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``path``, read them back, assemble: ``capture_digests`` of every page."""
    write_archives(pages, path, min_revisit_bytes)
    return capture_digests(stored(assemble_captures(read_records(pages.sparkSession, path, payload=False))))
