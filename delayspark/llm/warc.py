"""WARC archives with revisit resolution.

:func:`resolve_revisits` shuffles narrow headers by payload digest and gives every record of a
repeated payload the record it revisits; :func:`write_archive` writes the records with fresh headers
(payload once, revisits without it); :func:`read_archive` reads any archive back by content length and
:func:`resolved` joins revisit records to their original responses.

Spark's own text writer writes the files (a record, then an empty line), so they go through its
commit protocol to any file system and a lost executor leaves no half file.  Files hold at most
``RECORDS_PER_FILE`` records, which bounds what a reading task holds.

Scale: digests are grouped with map-side aggregation.  The table of repeated payloads meets the
payloads by a broadcast while it has at most ``MAX_BROADCAST_REPEATED`` rows (payloads then never
move), else by a shuffle join on (digest, id), which no shared payload makes uneven.

Defined results: a null payload is empty; payloads under ``MIN_REVISIT_BYTES`` are always responses;
null ids come last when the smallest is chosen; of rows that repeat the same id and payload one is
the response (by address) and the others revisit it; carriage returns and line feeds in an address
are written percent-encoded; a null address leaves its header out; an empty table gives no record;
extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, written

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 1000
MAX_BROADCAST_REPEATED = 100_000  # rows of about 100 bytes
BATCH_BYTES = 8_000_000  # payload bytes in one batch that a reading task hands to Spark

# --- fixed values of the format ------------------------------------------------------------------
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Adds ``digest, payload_bytes, record_type, record_id, refers_id, refers_record`` to
    ``id, uri, payload`` (payload as string)."""
    records = records.select("id", "uri", F.coalesce("payload", F.lit("")).alias("payload"))
    records = records.withColumns({"digest": F.sha2("payload", 256),
                                   "payload_bytes": F.octet_length("payload").cast("long")})
    heads = records.select("id", "digest", "payload_bytes")
    group = heads.groupBy("digest").agg(F.min("id").alias("refers_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # every (payload, id) of a repeated payload, with the rows that repeat it
    known = (heads.groupBy("digest", "id").agg(F.count("*").alias("same")).join(group, "digest")
             .select(F.col("digest").alias("d"), F.col("id").alias("i"), "refers_id", "same"))
    known = bounded(written(known, "warc-repeated"), MAX_BROADCAST_REPEATED)
    joined = records.join(known, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left").drop("d", "i")
    # only rows that repeat id and payload have to be numbered
    once = joined.where("same is null or same = 1").withColumn("at", F.lit(1))
    again = joined.where("same > 1").withColumn("at", F.row_number().over(Window.partitionBy("digest", "id").orderBy("uri")))
    rows = once.unionByName(again)
    original = (F.col("same").isNull() | (F.col("payload_bytes") < MIN_REVISIT_BYTES)
                | (F.col("id").eqNullSafe(F.col("refers_id")) & (F.col("at") == 1)))
    return rows.select(
        "id", "uri", "payload", "digest", "payload_bytes",
        F.when(original, "response").otherwise("revisit").alias("record_type"),
        _record_id(F.col("digest"), F.col("id"), F.col("at")).alias("record_id"),
        F.when(~original, F.col("refers_id")).alias("refers_id"),
        F.when(~original, _record_id(F.col("digest"), F.col("refers_id"), F.lit(1))).alias("refers_record"))


def _record_id(digest: Column, key: Column, at: Column) -> Column:
    h = F.md5(F.concat_ws(":", digest, F.coalesce(key.cast("string"), F.lit("-")), at.cast("string")))
    return F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")


def _header(name: str, value: Column) -> Column:
    """``Name: value`` and a line end; nothing when the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def record_text(date: str) -> Column:
    """The whole record, without the empty line that ends it."""
    uri = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"{VERSION}{CRLF}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), F.col("refers_record"), F.lit(">")))),
        _header("X-Source-Id", F.col("id").cast("string")),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block)


def write_archive(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                  records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write resolved records as gzip-compressed archives below ``path``."""
    (records.select(record_text(date).alias("value")).write
     .option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records of one archive, by their content lengths."""
    at, size = 0, len(data)
    while at < size:
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(head["content-length"])
        block = data[end + 4:end + 4 + length]
        if len(block) != length:
            raise ValueError(f"record at byte {at} is cut short")
        yield head, block
        at = end + 4 + length
        while data.startswith(b"\r\n", at):
            at += 2


READ_SCHEMA = ("record_id string, record_type string, uri string, source_id string, digest string, "
               "payload_bytes long, refers_record string, payload binary")


def _rows(head: dict[str, str], block: bytes, payload: bool) -> tuple:
    body = block.split(b"\r\n\r\n", 1)[1] if head.get("content-type", "").startswith("application/http") else block
    said = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    digest, n = said, None
    if head["warc-type"] == "response":
        digest, n = hashlib.sha256(body).hexdigest(), len(body)
        if said and said != digest:
            raise ValueError(f"record {head.get('warc-record-id')}: its payload does not have its digest")
    return (head.get("warc-record-id", "").strip("<>") or None, head["warc-type"], head.get("warc-target-uri"),
            head.get("x-source-id"), digest, n, head.get("warc-refers-to", "").strip("<>") or None,
            body if payload and n is not None else None)


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of all archives below ``path``; a response's digest and length are those of its
    payload as read (a different digest in its header is an error)."""
    schema = pa.schema([(n.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[n.split()[1]])
                        for n in READ_SCHEMA.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                rows, held = [], 0
                for head, block in parse_records(gzip.decompress(data) if name.endswith(".gz") else data):
                    rows.append(_rows(head, block, payload))
                    held += len(block) if payload else 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, READ_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """One row per record with the digest, length and source id of its payload: revisits get them
    from the response they refer to."""
    heads = records.select("record_id", "record_type", "uri", "source_id", "digest", "payload_bytes", "refers_record")
    originals = heads.where("record_type = 'response'").select(
        F.col("record_id").alias("o_id"), F.col("digest").alias("o_digest"),
        F.col("payload_bytes").alias("o_bytes"), F.col("source_id").alias("o_source"))
    revisits = (heads.where("record_type = 'revisit'").join(originals, F.col("refers_record") == F.col("o_id"), "left")
                .select("record_id", "record_type", "uri", "source_id", F.coalesce("o_digest", "digest").alias("digest"),
                        F.col("o_bytes").alias("payload_bytes"), F.col("o_source").alias("refers_to")))
    responses = (heads.where("record_type <> 'revisit'").drop("refers_record")
                 .withColumn("refers_to", F.lit(None).cast("string")))
    return responses.unionByName(revisits)
