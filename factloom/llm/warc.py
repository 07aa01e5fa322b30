"""WARC archives: writing pages with revisits, reading archives, and assembling captures.

A capture is a request, a response or revisit, and a metadata record. The request and the metadata name the response in
WARC-Concurrent-To; reading joins the three through it, wherever in the archives they lie, into one nested row.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Cleaning
from .common import durable, fresh_dir

LEAST_REVISIT = 1000
#: Bytes, before compression, at which a file is closed; a larger capture has a file of its own.
FILE_BYTES = 64 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, content_type: str, block: Column, **more: Column) -> Column:
    """The text of a record up to its closing empty lines; headers that are null are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), *((k.replace("_", "-"), v) for k, v in more.items()), ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in head])
    return F.concat(lines, F.lit(END), block)


def members(captures: DataFrame, file_bytes: int) -> DataFrame:
    """(file, value): each record of the arrays ``records`` as a gzip member but for its last byte, and the number of its file within the task.

    Files are written as lines that a zero byte ends, and that byte belongs to the member: the last of a member is the top byte of its
    length, zero below 16 MB. A longer one is followed by an empty member.
    """
    empty = gzip.compress(b"", mtime=0)

    def run(batches):
        number, held = 0, 0
        for batch in batches:
            for capture in batch.column(0):
                files, values = [], []
                for record in capture.values.cast(pa.binary()):
                    raw = record.as_buffer()
                    if held and held + raw.size > file_bytes:
                        number, held = number + 1, 0
                    held += raw.size
                    packed = gzip.compress(raw, 6, mtime=0)
                    packed = packed if packed[-1] == 0 else packed + empty
                    files.append(number)
                    values.append(packed[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(values, pa.binary())], ["file", "value"])

    return captures.select("records").mapInArrow(run, "file int, value binary")


def write_archives(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Archive (page_id, url, html): files of WARC records in ``path``, a gzip member each, of about ``file_bytes`` before compression.

    Of pages with equal payloads of ``least_revisit`` bytes or more the one with the largest page_id is the response, all rows of that
    page_id if there are several, and the others revisit it. Null html is an empty payload, a null url gives records without a target;
    line breaks in urls become spaces.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("len", F.octet_length("html"))
    same = base.where((F.col("len") >= least_revisit) & F.col("page_id").isNotNull()).groupBy("digest", "len").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    reps = durable(same.where("n > 1").select("digest", "len", "first"), "payloads")
    d = base.join(reps, ["digest", "len"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    url, none = F.col("url"), F.lit(None).cast("string")
    me = _uuid(F.lit("capture"), F.col("page_id"), url, F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("len").cast("string"), F.lit(END))
    response = _record(
        F.when(again, "revisit").otherwise("response"), me, url, "application/http; msgtype=response", F.when(again, http).otherwise(F.concat(http, "html")),
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), "digest"), WARC_Profile=F.when(again, F.lit(REVISIT_PROFILE)),
        WARC_Refers_To=F.when(again, _uuid(F.lit("capture"), F.col("first.page_id"), F.col("first.url"), F.col("digest"))), WARC_Refers_To_Target_URI=F.when(again, F.col("first.url")),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\nAccept: text/html"), F.lit(END))
    request = _record(F.lit("request"), _uuid(F.lit("request"), F.col("page_id"), url, F.col("digest")), url, "application/http; msgtype=request", asked, WARC_Concurrent_To=me)
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.lit("via: factloom"))
    metadata = _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("page_id"), url, F.col("digest")), none, "application/warc-fields", fields, WARC_Concurrent_To=me)
    records = F.array(*[F.concat(x, F.lit(END)) for x in (request, response, metadata)])
    # bytes as they are: the text writer copies what a string holds
    stored = members(d.select(records.alias("records")), file_bytes).select("file", F.col("value").cast("string").alias("value"))
    with Cleaning(pages.sparkSession):
        stored.write.partitionBy("file").option("lineSep", "\0").text(path)


def parse_archive(raw):
    """The records of an archive, plain or gzip of one or many members: (headers with lower-case names, block) each, in order, without holding more than one."""
    f = io.BufferedReader(pa.BufferReader(raw))
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = gzip.GzipFile(fileobj=f)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, f.read(int(headers.get("content-length") or 0))


RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, http string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``path``. ``payload`` is what follows the HTTP head of requests and responses; its digest is that of the bytes read."""
    names = [x.strip().split(" ")[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.map_(pa.string(), pa.string()) if n == "fields" else pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows, size = [], 0
                for h, block in parse_archive(raw.as_buffer()):
                    kind, http, payload, fields = h.get("warc-type"), None, None, None
                    if "application/http" in h.get("content-type", ""):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", "replace")
                    elif "warc-fields" in h.get("content-type", ""):
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()]
                    else:
                        payload = block
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), http, None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).hexdigest(), fields, payload if with_payload else None))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, response, request, metadata, refers_to).

    ``response`` is a response or revisit record; the request and metadata that name it in concurrent-to join it, or null; of
    several the one with the least record id. ``refers_to`` is the record a revisit names.
    """
    columns = list(records.columns)
    main = records.where(F.col("type").isin("response", "revisit", "resource")).select(F.col("record_id").alias("capture_id"), F.struct(*columns).alias("response"), "refers_to")

    def side(kind: str) -> DataFrame:
        small = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return small.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(F.struct(*columns), "record_id").alias(kind))

    return main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages``, read the archives back and give (page_id, payload_bytes, payload_digest, record_type, refers_to), a row a page.

    Null html is an empty payload. Pages with a null page_id come back with a null; they can revisit, and are never the response that
    others revisit. Rows that repeat come back as often. An empty table gives an empty one. Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or fresh_dir(spark, "archive")
    write_archives(pages, path)
    records = durable(read_records(spark, path, with_payload=False).drop("payload"), "records")
    captures = assemble(records).select(
        "capture_id", "refers_to", F.col("response.type").alias("record_type"), F.col("response.digest").alias("stated"),
        F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_digest").alias("found"), F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
    )
    captures = durable(captures, "captures")
    # a revisit holds no payload: its size and the page it refers to come from the response
    target = captures.where("record_type = 'response'").groupBy(F.col("capture_id").alias("refers_to")).agg(F.min("bytes").alias("target_bytes"), F.min("page_id").alias("target_page"))
    both = captures.join(target, "refers_to", "left")
    again = F.col("record_type") == "revisit"
    return both.select(
        "page_id", F.when(again, F.col("target_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("stated", "^sha1:", "")).otherwise(F.col("found")).alias("payload_digest"), "record_type", F.when(again, F.col("target_page")).alias("refers_to"),
    )
