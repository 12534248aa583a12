"""WARC archives with revisit records.

Headers (digest, length, id) are grouped by payload digest to find the response of each payload; the decisions go back to the
pages by page id, so no shuffle of payloads is keyed by a hot digest. Archives are written by Spark's text writer, whose
committer makes reruns of lost tasks safe and which reaches any store: a WARC record ends with two line ends, and with these as
the line separator a part file is a WARC file. Reading takes the files whole (they are as large as a shuffle partition) and
parses them by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, keep

#: The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
_RECORD = ("record_id string, record_type string, url string, page_id long, refers_id string, payload_digest string, "
           "payload_bytes long, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(g, shift).bitwiseAND(31) + 1, F.lit(1))
                      for g in groups for shift in (15, 10, 5, 0)])


def headers(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload keys, record type and the page a revisit refers to, one row per distinct (page_id, payload)."""
    keys = pages.select("page_id", "payload_bytes", "payload_digest", "check").distinct()
    payload = ["payload_digest", "payload_bytes", "check"]
    # Kept, so that both sides of the join are plain shuffles and a hot payload can be split by adaptive execution.
    first = keep(keys.groupBy(payload).agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages"))
                 .where("pages > 1").drop("pages"), "warc-first")
    joined = keys.join(first, payload, "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)
    return joined.select(
        "page_id", "check", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("first_id"))


def record_id(page_id: Column, digest: Column) -> Column:
    """A stable urn:uuid made from the page id and its payload digest."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of pages (page_id, url, html) to gzip WARC files under path.

    Of equal payloads (UTF-8 html, null is empty) of at least min_bytes bytes, the one with the smallest page_id is a response
    and the others revisit it; smaller payloads are all responses. Rows with a null page_id never come first; if all rows of a
    payload lack an id, all are responses. Rows alike in page_id and payload become equal records. Line ends in a url are
    percent-encoded, a null url is left out. Other columns are not read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    payload = html.cast("binary")
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"),
        F.sha2(payload, 256).alias("check"))
    decided = headers(full, min_bytes).withColumnsRenamed({"page_id": "decided_id", "check": "decided_check"})
    rows = full.join(decided, F.col("page_id").eqNullSafe(F.col("decided_id")) & (F.col("check") == F.col("decided_check")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    is_response = F.col("record_type") == "response"
    body = F.concat(http, F.when(is_response, F.col("html")).otherwise(""))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"))

    head = F.concat_ws(  # a null line is left out
        CRLF, F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url), line("WARC-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(~is_response, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(~is_response, line("WARC-Refers-To", record_id(F.col("first_id"), F.col("payload_digest")))),
        F.lit("Content-Type: application/http;msgtype=response"), line("Content-Length", F.octet_length(body)))
    (rows.select(F.concat(head, F.lit(CRLF + CRLF), body).alias("value"))
     .write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path))


def parse(content: bytes) -> Iterator[tuple]:
    """Records of one WARC file. Lengths decide where a record ends, so payloads may hold any bytes."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in content[at:end].decode().split(CRLF)[1:])
        body_at = end + 4
        body_end = body_at + int(fields["Content-Length"])
        at = body_end + 4
        payload = content[content.index(b"\r\n\r\n", body_at, body_end) + 4:body_end]
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page = int(fields["WARC-Page-ID"]) if "WARC-Page-ID" in fields else None
        common = (fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"), page, fields.get("WARC-Refers-To"))
        if fields["WARC-Type"] == "revisit":
            yield *common, stated, None, None
            continue
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        yield *common, stated, len(payload), payload


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in _RECORD.split(", ")]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)],
                                          names=[n for n, _ in fields])

    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for row in parse(zlib.decompress(content.as_py(), 47)):
                rows.append(row)
                held += len(row[-1] or b"")
                if held > 8 << 20 or len(rows) >= 5000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records under path: record_id, record_type, url, page_id, refers_id, payload_digest, payload_bytes, payload.

    A response's digest is checked against its payload; a damaged file fails the read. Revisits have no payload or length.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records, _RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisits joined to their responses: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    slim = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_id", "record_id")
    origin = (slim.where("record_type = 'response'").dropDuplicates(["record_id"])
              .select(F.col("record_id").alias("origin_id"), F.col("page_id").alias("refers_to"),
                      F.col("payload_bytes").alias("origin_bytes")))
    return slim.join(origin, F.col("refers_id") == F.col("origin_id"), "left").select(
        "page_id", F.coalesce("payload_bytes", "origin_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        "refers_to")


def revisit_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as deduplicated archives in the shared folder, read them back and resolve the revisits."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return resolve_revisits(keep(read_archives(pages.sparkSession, path).drop("payload"), "warc-headers"))
