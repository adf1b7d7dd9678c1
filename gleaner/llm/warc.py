"""WARC archives: writing, reading, and revisit resolution across a whole collection.

An archive is a folder of gzip files, each a plain sequence of WARC/1.1 records. Records are composed by Spark expressions
and written by its text writer with the record separator of the format as line separator, so any file system that Spark
writes to will do. Reading takes each file as one binary row and follows the ``Content-Length`` of the records. Files are
bounded in bytes: records lie in folders by their size, and the larger the fewer share a file, down to one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, delete_folder

#: Payloads up to so many bytes lie in files of at most so many records: 64 MiB a file, or one record.
FILES = ((1 << 16, 1_000), (1 << 20, 64), (1 << 24, 4), (1 << 62, 1))
#: Payload bytes of a batch of records that are read.
BATCH_BYTES = 8 << 20
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Of records whose pages carry no time of capture.
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def record_id(page_id: Column, digest: Column) -> Column:
    """A URN that depends on the page and its payload only, so a repeated task writes the same record."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    dashed = F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line breaks in a value would end the header and are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def size_class(payload_bytes: Column) -> Column:
    """The place in ``FILES`` of a payload."""
    return F.array_position(F.array(*[payload_bytes <= most for most, _ in FILES]), True).cast("int") - 1


def write_archive(records: DataFrame, path: str) -> None:
    """Write ``page_id, url, payload, payload_digest, refers_to`` (a page id, null for responses) as WARC records.

    ``payload`` is a string, stored in UTF-8; of a revisit only the HTTP headers are stored. The records are read once to
    see which size classes there are, and once for each of them.
    """
    size = size_class(F.octet_length("payload"))
    for (k,) in sorted(records.select(size).distinct().collect()):
        _write_class(records.where(size == k), path, k)


def _write_class(records: DataFrame, path: str, k: int) -> None:
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")
    http = F.concat(F.lit(HTTP), size.cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(size)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("X-Page-ID", F.col("page_id")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("payload_digest")))),
        _header("WARC-Refers-To-Date", F.when(revisit, DATE)),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", length),
        F.lit("\r\n"),
    )
    writer = records.select(F.concat(head, block).alias("value")).write.option("lineSep", END)
    writer.option("maxRecordsPerFile", FILES[k][1]).option("compression", "gzip").text(f"{path}/size={k}")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {version[:40]!r}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} doesn't end at its length")
        yield headers, data[start:at]
        at += 4


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: ``page_id, url, record_type, record_id, refers_to_id, payload_digest, payload_bytes`` and, with
    ``payloads``, ``payload`` (null for revisits).

    A response's digest and length are taken from its stored payload, and a digest that contradicts the header fails the
    read. A revisit's come from its header; its length is that of its original and null here.
    """
    names = ["page_id", "url", "record_type", "record_id", "refers_to_id", "payload_digest", "payload_bytes", *["payload"] * payloads]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), *[pa.string()] * payloads]

    def rows(content: bytes) -> Iterator[tuple[int, tuple]]:
        for h, block in parse_records(zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content):
            digest, payload = h["warc-payload-digest"].removeprefix("sha256:"), None
            if h["warc-type"] == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"record {h['warc-record-id']} doesn't match its digest")
            page = int(h["x-page-id"]) if "x-page-id" in h else None
            row = (page, h.get("warc-target-uri"), h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), digest, None if payload is None else len(payload))
            yield len(block), (*row, payload.decode() if payload is not None else None) if payloads else row

    def together(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for size, row in rows(content.as_py()):
                    found.append(row)
                    held += size
                    if held > BATCH_BYTES:
                        yield together(found)
                        found, held = [], 0
        if found:
            yield together(found)

    schema = "page_id long, url string, record_type string, record_id string, refers_to_id string, payload_digest string, payload_bytes long" + ", payload string" * payloads
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, schema)


def originals(headers: DataFrame) -> DataFrame:
    """``payload_digest, original_id``: the smallest page id of each payload of at least the minimum size that repeats."""
    large = headers.where(f"payload_bytes >= {MIN_REVISIT_BYTES}")
    return large.groupBy("payload_digest").agg(F.min("page_id").alias("original_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def dedup_archive(spark: SparkSession, source: str, target: str, scratch: Scratch) -> None:
    """Write the records of one archive to another, with repeated payloads as revisits of the record with the smallest id.

    Headers alone are shuffled by digest. The decisions on revisits meet the records by page id: while they are small enough
    to broadcast, payloads don't move; beyond, each payload is shuffled once.
    """
    headers = scratch.table(read_archive(spark, source), "headers")
    revisits = (
        headers.where(f"payload_bytes >= {MIN_REVISIT_BYTES}")
        .join(scratch.table(originals(headers), "originals"), "payload_digest")
        .where("page_id is null or page_id <> original_id")
        .select(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), F.col("original_id").alias("refers_to"))
        .distinct()
    )
    revisits = scratch.table(revisits, "revisits")
    for (k,) in sorted(headers.select(size_class(F.col("payload_bytes"))).distinct().collect()):
        records = read_archive(spark, f"{source}/size={k}", payloads=True)
        match = records["page_id"].eqNullSafe(revisits["r_page"]) & (records["payload_digest"] == revisits["r_digest"])
        fresh = records.join(revisits, match, "left").select("page_id", "url", "payload", "payload_digest", "refers_to")
        _write_class(fresh, target, k)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Join revisits to their responses: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    responses = records.where("record_type = 'response'").select("record_id", F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"))
    joined = records.where("record_type = 'revisit'").join(
        responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("o_page").alias("o_page"), F.min("o_bytes").alias("o_bytes")), "refers_to_id"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return records.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"), "url").union(
        joined.select("page_id", F.col("o_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("o_page").alias("refers_to"), "url")
    )


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", target: str | None = None
) -> DataFrame:
    """Archive pages, deduplicate the archive, read it back and resolve its revisits; one row per page.

    The deduplicated archive stays in ``target``; without one, it is deleted once it has been read back. Null html is an
    empty payload; a null url has no target header. Of equal payloads of at least 100 bytes the rows with the smallest page
    id are responses (all of them if the id repeats), the others revisit; among null ids only, all are responses. An empty
    table gives an empty result and no archive. Extra columns are ignored. Ids are integers.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"),
    )
    if rows.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    raw, deduped = scratch.folder("raw"), target or scratch.folder("deduped")
    write_archive(rows, raw)
    dedup_archive(spark, raw, deduped, scratch)
    delete_folder(spark, raw)
    records = scratch.table(read_archive(spark, deduped), "records")
    if not target:
        delete_folder(spark, deduped)
    return resolve_revisits(records)
