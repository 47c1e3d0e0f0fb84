"""WARC archives: writing captures as request, response (or revisit) and metadata records, and assembling them again.

``write`` makes plain text lines of whole records and lets Spark's text writer put ``CRLF CRLF`` after each, which is just
how a record ends; the commit protocol then survives lost executors, and gzip makes ``.gz`` archives (a member for each
archive, not for each record: Spark has no writer of bytes).  ``read_records``
streams through archives by ``Content-Length``, so payloads may hold anything, also what looks like a record.  ``assemble``
joins requests and metadata to their response through ``WARC-Concurrent-To`` and gives one nested row per capture.

Defined cases: a null html is an empty payload; of equal payloads of at least ``LEAST`` bytes the smallest ``page_id`` is
the response (rows that repeat that id are all responses; a null id counts as larger than any); repeated rows are
captures of their own; null urls are written empty; an empty table gives an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Scratch, small, with_rows

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20  # of an archive before compression; a reader holds one at a time
SIZES = (1 << 15, 1 << 20)  # of payloads that are written together
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
CRLF = "\r\n"


def _urn(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise("") for k, v in headers]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def decisions(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """``pages`` with row, payload, digest, and for revisits the row and page that they refer to."""
    rows = with_rows(pages, ["page_id", "url", "html"], scratch)
    rows = rows.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("payload"), "row"
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = rows.filter(F.octet_length("payload") >= least)
    first = large.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.keep(first.select(F.col("digest").alias("_d"), F.col("f.page_id").alias("first_page"), F.col("f.row").alias("first_row")), "first")
    again = (F.col("digest") == F.col("_d")) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return rows.join(small(first, 100_000), again, "left").drop("_d")


def _sized(rows: DataFrame) -> list[tuple[DataFrame, int]]:
    """The rows by size of payload, and how many pages of each size make an archive of ``FILE_BYTES`` at most (or one page)."""
    size, out, low = F.octet_length("payload"), [], -1
    for high in SIZES:
        out.append((rows.filter((size > low) & (size <= high)), max(1, FILE_BYTES // (high + 4096))))
        low = high
    return [*out, (rows.filter(size > low), 1)]


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Archives below ``path``: gzip files of a warcinfo record and some pages' request, response or revisit, and metadata records."""
    rows = decisions(pages, Scratch(pages.sparkSession, "warc"), least)
    uri, response, payload = F.col("url"), _urn("response", F.col("row")), F.col("payload")
    revisit = F.col("first_row").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    head = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("first_row")))), ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_replace(uri, "^[a-zA-Z]+://[^/]*", ""), F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract(uri, "^[a-zA-Z]+://([^/]*)", 1), F.lit(CRLF + CRLF))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-bytes: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    beside = lambda kind: [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", _urn(kind, F.col("row"))), *common, ("WARC-Concurrent-To", response)]
    records = F.array(
        _record([*beside("request"), ("Content-Type", F.lit("application/http; msgtype=request"))], ask), _record(head, F.when(revisit, http).otherwise(F.concat(http, payload))),
        _record([*beside("metadata"), ("Content-Type", F.lit("application/warc-fields"))], about),
    )
    info = _record([("WARC-Type", F.lit("warcinfo")), ("WARC-Record-ID", _urn("warcinfo", F.col("row"))), ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/warc-fields"))], F.lit(f"software: signalframe{CRLF}format: WARC File Format 1.1{CRLF}"))
    for k, (part, n) in enumerate(_sized(rows)):
        # a file's first page brings the warcinfo record: the writer cuts after as many records, so places in a task tell where files begin
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        lines = part.withColumn("_first", place % n == 0).select(F.explode(F.when(F.col("_first"), F.concat(F.array(info), records)).otherwise(records)).alias("value"))
        lines.write.mode("overwrite").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * n + 1).text(f"{path}/size-{k}")


def parse(stream):
    """Headers (lower-case names) and block of every record of an uncompressed archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


def _row(headers: dict, block: bytes, keep: bool) -> dict:
    kind, payload, fields, digest, size = headers.get("warc-type"), None, {}, headers.get("warc-payload-digest"), None
    if kind in ("request", "response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind in ("metadata", "warcinfo"):
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k.strip()}
    else:
        payload = block
    if kind == "response":
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    elif payload is not None:
        size = len(payload)
    if digest and digest.startswith("sha256:"):
        digest = digest[7:]
    return {
        "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"), "payload_digest": digest, "payload_bytes": size, "payload": payload if keep else None, "fields": list(fields.items()),
    }


def read_records(spark: SparkSession, path: str, payloads: bool = True, per_batch: int = 2 << 20) -> DataFrame:
    """All records of the archives below ``path`` (plain or gzip).  Digest and size of responses are those of what was read."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = pa.schema([pa.field(n, t) for n, t in (*((n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())))])
        for batch in batches:
            for content in batch.column("content"):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw
                rows, size = [], 0
                for headers, block in parse(stream):
                    rows.append(_row(headers, block, payloads))
                    size += 500 + len(block)
                    if size > per_batch:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit with its request and its metadata nested beside it."""
    part = lambda kinds, name: records.filter(F.col("type").isin(*kinds)).select(F.struct("*").alias(name))
    main, ask, about = part(("response", "revisit"), "response"), part(("request",), "request"), part(("metadata",), "metadata")
    out = main.join(ask, F.col("response.record_id") == F.col("request.concurrent_to"), "left").join(about, F.col("response.record_id") == F.col("metadata.concurrent_to"), "left")
    return out.select(F.col("response.record_id").alias("capture_id"), F.col("response.target_uri").alias("target_uri"), "request", "response", "metadata")


def digest(captures: DataFrame) -> DataFrame:
    """What the captures say of their pages; a revisit's page of reference is found through its record."""
    page = F.nullif(F.element_at("metadata.fields", "page-id"), F.lit("")).cast("long")
    base = captures.select(
        "capture_id", page.alias("page_id"), F.when(F.col("response.type") == "response", F.col("response.payload_bytes")).otherwise(F.element_at("metadata.fields", "payload-bytes").cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_ref"),
    )
    named = base.select(F.col("capture_id").alias("_id"), F.col("page_id").alias("refers_to"))
    return base.join(named, F.col("_ref") == F.col("_id"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
