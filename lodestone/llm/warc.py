"""WARC archives: writing captures, reading them back, and assembling transactions.

Archives are plain concatenated records, written through the engine's own text writer (a record is UTF-8 text, and the
line separator is the blank line that ends it), so any storage that Spark can reach will do. Equal payloads are found by
a minimum per digest; only one record holds them, the others are revisits. Reading takes one file per row, of bounded
size, and transactions are joined by record ids through WARC-Concurrent-To, in either direction.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.columns import text_of
from lodestone.plans.scratch import Scratch

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

ARCHIVE_BYTES = 24 << 20  # payload bytes that a file should hold; a single larger record makes a larger file
_NEVER = "1970-01-01T00:00:00Z"

RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("headers", pa.map_(pa.string(), pa.string())),
    ("http_headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary())])
_DDL = ("record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, "
        "headers map<string,string>, http_headers map<string,string>, payload_bytes long, payload_digest string, payload binary")


def sha1_base32(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8 bytes."""
    digest = F.sha1(text.cast("binary"))
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(digest, 1 + at, 10), 16, 32), 8, "0") for at in range(0, 40, 10)]
    return F.translate(F.concat(*parts), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: Column, record: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its final blank line. Headers of null value are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html",
               date: str = _NEVER, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``pages``.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the smallest key are responses (repeated
    rows each), the others revisit them; smaller payloads are all responses. A null body is an empty payload, a null key
    or URL leaves its header out, and blanks or control characters in a URL are written as %20. A null key is larger
    than all others. Other columns are not read; an empty table writes an archive without records.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20").alias("url"), text_of(body).alias("body"))
    rows = rows.withColumns({"digest": sha1_base32(F.col("body")), "size": F.octet_length("body").cast("long")})
    stats = rows.agg(F.count("*"), F.sum("size")).first()
    each = max(1, int(archive_bytes * stats[0] / max(stats[1] or 0, archive_bytes)))
    first = (rows.filter(F.col("size") >= least_bytes).groupBy("digest")
             .agg(F.min("key").alias("first"), F.min_by("url", "key").alias("first_url"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    # written first: the engine then knows its size, and shuffles the payloads only if there are many repeated ones
    joined = rows.join(Scratch(pages.sparkSession, "warc").write(first, "first"), "digest", "left")
    again = F.coalesce((F.col("size") >= least_bytes) & F.col("first").isNotNull()
                       & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    joined = joined.withColumns({"again": again, "base": F.uuid()})
    uid = lambda tag: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat("base", F.lit(tag))),
                               "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    dated = [("WARC-Date", F.lit(date))]
    target = [*dated, ("WARC-Target-URI", F.col("url"))]
    common = [*target, ("X-Page-ID", F.col("key").cast("string"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = F.when(F.col("again"), _record(F.lit("revisit"), uid("response"), [
        *common, digest, http, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To-Target-URI", F.col("first_url")),
        ("X-Refers-To-Page-ID", F.col("first").cast("string"))], head)).otherwise(
        _record(F.lit("response"), uid("response"), [*common, digest, http], F.concat(head, F.col("body"))))
    request = _record(F.lit("request"), uid("request"), [
        *target, ("WARC-Concurrent-To", uid("response")), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END}")))
    metadata = _record(F.lit("metadata"), uid("metadata"), [
        *dated, ("WARC-Concurrent-To", uid("response")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payloadBytes: "), F.col("size").cast("string"), F.lit("\r\n")))
    (joined.select(F.explode(F.array(request, response, metadata)).alias("value")).write.mode("errorifexists")
     .option("lineSep", END).option("maxRecordsPerFile", 3 * each).text(path))


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    pairs = (line.partition(b":") for line in lines if b":" in line)
    return [(a.strip().decode("utf-8", "replace"), b.strip().decode("utf-8", "replace")) for a, _, b in pairs]


def parse_archive(data: bytes, keep_payload: bool = True):
    """The records of one uncompressed archive, as dictionaries of the columns of ``RECORD``."""
    at, size = 0, len(data)
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at >= size:
            return
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = _fields(lines[1:])
        headers = {name.lower(): value for name, value in fields}
        start = head + 4
        end = start + int(headers["content-length"])
        if end > size:
            raise ValueError(f"record at byte {at} is cut short")
        block, http, at = data[start:end], {}, end
        if headers.get("content-type", "").startswith("application/http"):
            top, _, block = block.partition(b"\r\n\r\n")
            http = {name.lower(): value for name, value in _fields(top.split(b"\r\n")[1:])}
        revisit = headers.get("warc-type") == "revisit"
        yield {
            "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"),
            "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
            "concurrent_to": [v for n, v in fields if n.lower() == "warc-concurrent-to"],
            "headers": list(headers.items()), "http_headers": list(http.items()),
            "payload_bytes": int(http.get("content-length", 0)) if revisit else len(block),
            "payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2] if revisit
            else base64.b32encode(hashlib.sha1(block).digest()).decode(),
            "payload": block if keep_payload and not revisit else None}


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of all uncompressed archives of a folder. A broken archive fails the read, naming the byte.

    Length and digest of a payload are taken from its bytes; those of a revisit, which has none, from its headers.
    """

    def of(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in parse_archive(content.as_py(), keep_payload):
                    rows.append(record)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(of, _DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id, response, requests, metadata, others``, all nested.

    ``response`` is a response, revisit or resource record; the lists hold the records that name it as concurrent, or
    that it names, sorted by record id. Requests without a response make a capture under the id they name, or their own.
    Records without an id are left out. Repeated records stay repeated.
    """
    known = records.filter(F.col("record_id").isNotNull())
    whole = F.struct(*[F.col(c) for c in records.columns])
    is_main = F.col("record_type").isin("response", "revisit", "resource")
    main = known.filter(is_main).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    side = known.filter(~F.coalesce(is_main, F.lit(False)))
    named = known.filter(is_main).select(F.col("record_id").alias("target"), F.explode("concurrent_to").alias("record_id"))
    naming = side.select("record_id", F.explode("concurrent_to").alias("target"))
    links = named.select("record_id", "target").unionByName(naming).distinct()
    placed = side.join(links, "record_id", "left").select(
        F.coalesce("target", "record_id").alias("capture_id"), "record_type", whole.alias("record"))
    kind = lambda test: F.sort_array(F.collect_list(F.when(test, F.struct(
        F.col("record.record_id"), F.struct(*[F.col(f"record.{c}") for c in records.columns if "header" not in c])
        .alias("record")))))
    request, metadata = F.col("record_type") == "request", F.col("record_type") == "metadata"
    lists = placed.groupBy("capture_id").agg(
        kind(request).alias("requests"), kind(metadata).alias("metadata"),
        kind(~F.coalesce(request | metadata, F.lit(False))).alias("others"))
    return main.join(lists, "capture_id", "full").select(
        "capture_id", "response", *[F.transform(F.coalesce(c, F.array()), lambda x: x["record"]).alias(c)
                                    for c in ("requests", "metadata", "others")])
