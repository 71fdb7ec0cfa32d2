"""Web archives: transactions of request, response and metadata records, written, read and put together again.

Each page becomes three WARC records: the response (or, for a payload that another response holds, a revisit), the
request and a metadata record, the latter two bound to the first by ``WARC-Concurrent-To``. Archives are written by
Spark's text writer, whose line end is the end of a record, so a file appears when its task has committed; records keep their
lengths, and the reader goes by them alone. Reading gives one row per record; assembling joins the three to one
nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import new_folder, staged

#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on are written once.
MIN_REVISIT = 1_000
DATE = "2000-01-01T00:00:00Z"
ENVELOPE = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string"
RECORD = f"{ENVELOPE}, fields map<string, string>, payload_digest string, payload_bytes long, payload binary"


def one_line(column: Column) -> Column:
    """A header value without control characters, which are percent-encoded."""
    for code in (0, 10, 13):
        column = F.replace(column, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return column


def urn(*parts: Column) -> Column:
    """An identifier that depends on the values only."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its end; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines, length), F.lit(END), block)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Three records for every row of ``pages`` (``page_id``, ``url``, ``html``; other columns are ignored).

    A null html is an empty payload, a null url gives no target. Of equal payloads from ``min_revisit`` bytes on, the one
    with the largest ``page_id`` is the response and the others revisit it; rows that share that id, and rows
    with a null id, are responses. Equal rows are written as often as they come, with equal identifiers.
    """
    rows = pages.select("page_id", one_line(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha256", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    shared = staged(
        rows.filter(F.col("size") >= min_revisit).groupBy(F.col("sha256").alias("shared_sha256"))
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    rows = rows.join(shared, rows["sha256"] == shared["shared_sha256"], "left")
    revisits = F.coalesce((F.col("size") >= min_revisit) & (F.col("page_id") < F.col("response_id")), F.lit(False))
    own, kind = urn(F.col("page_id"), F.col("sha256"), F.lit("response")), F.when(revisits, "revisit").otherwise("response")
    digest = F.concat(F.lit("sha1:"), F.sha1("html"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    response = record([
        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(revisits, REVISIT_PROFILE)),
        ("WARC-Refers-To", F.when(revisits, urn(F.col("response_id"), F.col("sha256"), F.lit("response")))),
        ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.when(revisits, "").otherwise(F.col("html"))))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://[^/?#]*([^#]*)", 1)
    request = record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", urn(F.col("page_id"), F.col("sha256"), F.lit("request"))), ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    metadata = record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", urn(F.col("page_id"), F.col("sha256"), F.lit("metadata"))), ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n"))))
    rows.select(F.concat_ws(END, request, response, metadata)).write.option("lineSep", END).option("compression", "gzip").text(folder)


def fields_of(head: bytes) -> dict[str, str]:
    """Names (lower case) and values of header lines; of a repeated name the first."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def unzipped(content: bytes) -> bytes:
    """The bytes of one or more gzip members, or the content if it is not compressed."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out) or content


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive."""
    at = 0
    while at < len(content):
        if content[at:at + 2] == b"\r\n":  # the end of the record before
            at += 2
            continue
        head_end = content.find(b"\r\n\r\n", at)
        if head_end < 0 or content[at:at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        fields = fields_of(content[at:head_end])
        start = head_end + 4
        at = start + int(fields["content-length"])
        yield fields, content[start:at]


def hex_digest(labelled: str | None) -> str | None:
    """A digest header as bare lower-case hex; SHA-1 in base 32 is converted."""
    if not labelled:
        return None
    value = labelled.rpartition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def parsed(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a record. The payload is what follows the HTTP headers; that of a revisit is known by its headers only."""
    kind, payload, inner = fields.get("warc-type"), None, {}
    if "application/http" in fields.get("content-type", ""):
        head, _, payload = block.partition(b"\r\n\r\n")
        inner = fields_of(head)
    elif "warc-fields" in fields.get("content-type", ""):
        inner = fields_of(block)
    else:
        payload = block
    if kind == "revisit":
        size, digest, payload = inner.get("content-length"), hex_digest(fields.get("warc-payload-digest")), None
    else:
        size, digest = (None, None) if payload is None else (len(payload), hashlib.sha1(payload).hexdigest())
    return (kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"),
            list(inner.items()), digest, None if size is None else int(size), payload)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: type, identifiers, target, fields of its HTTP or warc-fields head, and payload with size and SHA-1.

    A task holds one archive at a time, as whole as its writer made it.
    """
    kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORD.replace("map<string, string>", "map").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in records_of(unzipped(content.as_py())):
                    rows.append(parsed(fields, block))
                    size += len(block)
                    if size > 4_000_000 or len(rows) >= 3_000:
                        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``response`` (or revisit), ``request``, ``metadata`` as structs, and ``original_metadata``.

    Requests and metadata belong to the record that they are concurrent to; of several, the one with the smallest
    identifier counts. A capture without them has nulls. ``original_metadata`` is that of the response that a revisit
    refers to. Requests and metadata without a capture are given by ``orphans``.
    """
    parts = {}
    for kind in ("request", "metadata"):
        chosen = F.min(F.struct("record_id", "target_uri", F.to_json("fields").alias("fields_json"))).alias(kind)
        parts[kind] = records.filter(F.col("record_type") == kind).filter("concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias(f"{kind}_of")).agg(chosen)
    request, metadata = parts["request"], staged(parts["metadata"])
    captures = records.filter(F.col("record_type").isin("response", "revisit")).select(F.struct("*").alias("response"))
    captures = captures.join(request, F.col("response.record_id") == F.col("request_of"), "left").join(
        metadata, F.col("response.record_id") == F.col("metadata_of"), "left").select("response", "request", "metadata")
    original = metadata.select(F.col("metadata_of").alias("original_of"), F.col("metadata").alias("original_metadata"))
    return captures.join(original, F.col("response.refers_to") == F.col("original_of"), "left").drop("original_of")


def orphans(records: DataFrame) -> DataFrame:
    """Requests and metadata that no capture of ``records`` is concurrent to."""
    captures = records.filter(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"))
    return records.filter(F.col("record_type").isin("request", "metadata")).join(captures, F.col("concurrent_to") == F.col("capture_id"), "left_anti")


def archive(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes ``pages`` to archives in a new folder, reads them and gives the captures of ``assemble``."""
    spark = pages.sparkSession
    folder = new_folder(spark)
    write_archives(pages, folder, min_revisit)
    return assemble(read_archives(spark, folder))
