"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds each distinct payload once under its SHA-256, with its number of records, and
``headers`` holds the exact WARC and HTTP-free header block of every record together with the
digest it points to. Original records are header block + payload, brought together by a join.

Defined results:
- a null html is an empty payload; a null url or page_id is written as the word ``null`` or ``-``;
- of rows with equal payloads the one with the largest page_id is the response (null ids last,
  then the largest url, then the largest row number of the scan), all others are revisits;
- payloads below ``min_dedup_bytes`` are all responses;
- repeated rows are separate records, so exactly one of them is the response;
- other columns of the input, whatever their names, are ignored; an empty input gives empty tables.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cdrspark.llm.common import shared_path, spread_join, written

CRLF = b"\r\n"


@dataclass(frozen=True)
class Archive:
    """Paths of the two stores."""

    payloads: str
    headers: str


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def header_block(page_id, row: int, url, sha1: str, length: int, kind: str, refers_to) -> bytes:
    """The header lines of one WARC/1.1 record, blank line included."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}:{row}>",
        f"WARC-Target-URI: {'-' if url is None else ' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>",
        ]
    lines.append(f"Content-Length: {0 if kind == 'revisit' else length}")
    return "".join(x + "\r\n" for x in lines).encode("utf-8") + CRLF


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def _page(urn: str | None) -> int | None:
    """The page id inside <urn:page:ID> or <urn:page:ID:ROW>."""
    if urn is None:
        return None
    text = urn.strip("<>").split(":")[2]
    return None if text == "null" else int(text)


def write_archive(pages: DataFrame, min_dedup_bytes: int = 0) -> Archive:
    """Write pages (page_id, url, html) as an archive in the shared folder.

    Payload bytes move once, to the task that owns their digest, after each map task has dropped
    its own repeats. Equal digests are verified to mean equal lengths and equal SHA-1 before a payload is stored.
    """
    spark = pages.sparkSession
    archive = Archive(shared_path(spark, "warc-payloads"), shared_path(spark, "warc-headers"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = [F.unhex(F.sha2(payload, 256)).alias("digest"), F.length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("sha1_hex")]
    store = pages.select(*facts, payload.alias("payload")).groupBy("digest")
    store = store.agg(F.any_value("payload").alias("payload"), F.count("*").alias("records"), *[f(F.struct("bytes", "sha1_hex")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    shown = F.when(F.col("lo") == F.col("hi"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256")))
    store.select("digest", shown.alias("payload"), "records").write.option("compression", "zstd").parquet(archive.payloads)

    # Only digests and ids from here on, with row numbers that are read again, not made again.
    ids = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.monotonically_increasing_id().alias("row")]
    narrow = written(pages.select(*ids, *facts), "warc-rows")
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("k"), F.col("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("u"), F.col("row"))
    keep = narrow.groupBy("digest").agg(F.max(order).alias("best"), F.count("*").alias("records"))
    keep = written(keep.select("digest", F.col("best.page_id").alias("best_id"), F.col("best.row").alias("best_row"), "records"), "warc-kept")
    joined = spread_join(narrow, keep, "digest", "records", narrow.count())
    first = (F.col("row") == F.col("best_row")) | (F.col("bytes") < F.lit(min_dedup_bytes))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for x in b.to_pylist():
                sha1 = base64.b32encode(bytes.fromhex(x["sha1_hex"])).decode("ascii")
                made.append(header_block(x["page_id"], x["row"], x["url"], sha1, x["bytes"], x["kind"], x["refers_to"]))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(made, pa.binary())], names=["digest", "header"])

    headers = joined.select(
        "page_id", "url", "row", "bytes", "sha1_hex", "digest",
        F.when(first, "response").otherwise("revisit").alias("kind"),
        F.when(first, F.lit(None).cast("long")).otherwise(F.col("best_id")).alias("refers_to"),
    )
    headers.mapInArrow(blocks, "digest binary, header binary").write.option("compression", "zstd").parquet(archive.headers)
    return archive


def _open(spark: SparkSession, archive: Archive) -> tuple[DataFrame, DataFrame]:
    payloads = spark.read.schema("digest binary, payload binary, records long").parquet(archive.payloads)
    headers = spark.read.schema("digest binary, header binary").parquet(archive.headers)
    return payloads, headers


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: ``record`` has the exact bytes of each (header block, payload unless a
    revisit, two line ends) and ``payload`` the full payload, for revisits too."""
    payloads, headers = _open(spark, archive)
    joined = headers.join(payloads.drop("records"), "digest")
    body = F.when(F.contains(F.col("header"), F.lit(b"WARC-Type: revisit\r\n")), F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", "payload", F.concat(F.col("header"), body, F.lit(CRLF + CRLF)).alias("record"))


def read_index(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record, read back from both stores: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, record_bytes. Stored payloads are hashed anew and must match the digest they lie
    under and the one in the header; a mismatch ends the job."""
    payloads, headers = _open(spark, archive)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload = b.column("payload").to_pylist()
            if any(hashlib.sha256(x).digest() != d for x, d in zip(payload, b.column("digest").to_pylist(), strict=True)):
                raise ValueError("a stored payload does not have its digest")
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("records"), pa.array([len(x) for x in payload], pa.int64()), pa.array([base32_sha1(x) for x in payload], pa.string())], names=["digest", "records", "payload_bytes", "payload_digest"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.to_pylist():
                h = parse_header(x["header"])
                if h["WARC-Payload-Digest"] != f"sha1:{x['payload_digest']}":
                    raise ValueError("a header's digest is not its payload's")
                uri = h["WARC-Target-URI"]
                out.append((_page(h["WARC-Record-ID"]), x["payload_bytes"], x["payload_digest"], h["WARC-Type"], _page(h.get("WARC-Refers-To")), None if uri == "-" else uri, len(x["header"]) + int(h["Content-Length"]) + 4))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.fieldNames())

    schema = T.StructType.fromDDL("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_bytes long")
    known = written(payloads.mapInArrow(facts, "digest binary, records long, payload_bytes long, payload_digest string"), "warc-known")
    return spread_join(headers, known, "digest", "records", headers.count()).drop("digest").mapInArrow(index, schema)


def op6_warc_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_dedup_bytes=0)
    return read_index(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base 32: five bits at a time out of the hexadecimal digest.
OP6_SQL = """
with p as (
  select page_id, coalesce(html, '') as html from pages),
h as (
  select page_id, html, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as hx from p),
d as (
  select page_id, html, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((
      ((instr('0123456789abcdef', substr(hx, cast(1 + (5 * i - (5 * i) % 4) / 4 as int), 1)) - 1) * 16
      + instr('0123456789abcdef', substr(hx, cast(2 + (5 * i - (5 * i) % 4) / 4 as int), 1)) - 1)
      >> cast(3 - (5 * i) % 4 as int)) & 31 as int), 1)), '') as payload_digest
  from h),
w as (
  select *, row_number() over (partition by html order by page_id desc nulls last) as n,
         first_value(page_id) over (partition by html order by page_id desc nulls last) as best
  from d)
select page_id, payload_bytes, payload_digest,
       case when n = 1 then 'response' else 'revisit' end as record_type,
       case when n = 1 then null else best end as refers_to
from w
"""
