"""Writing pages as WARC archives and reading archives back by boundary-chain verification.

Archives are written by Spark's text writer with the record terminator
(CRLF CRLF) as line separator, so files are committed like any other table. The
reader takes files apart at the same separator. A segment that starts with the
magic is only a *candidate* record: it may be inside a payload. Each candidate
names its successor (end of header + Content-Length + terminator), and pointer
jumping from offset 0 of each file, doubling the step each round, keeps the
records that the chain reaches.

Defined results: null html is an empty payload; equal payloads (empty ones too)
are one response, under the smallest page_id (a null id counts as larger than
any), and revisits that refer to it; rows that repeat page_id and payload of a
response are responses as well; CR and LF in a url become spaces, null urls and
ids are left out of the header; a chain ends where a record is cut short or its
successor isn't a record; no rows give archives without records; payloads of any
length are written and read whole (one record's payload is held at a time, with
those of false candidates inside it); ties between equal payloads go to the
smallest page_id; other columns, whatever their names, are left.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import new_path, table, written

CRLF, END = "\r\n", "\r\n\r\n"
MAGIC = "WARC/1.1"
_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})")
#: Records in an archive file at most.
RECORDS_PER_FILE = 1024


def base32_sha1(binary) -> F.Column:
    """Upper-case base32 of a SHA-1: each 5 hexadecimal digits make 4 characters."""
    digest = F.sha1(binary)
    quads = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, *, page_id="page_id", url="url", html="html", date="1970-01-01T00:00:00Z", records_per_file=RECORDS_PER_FILE) -> None:
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(firsts, "digest").withColumn("response", F.col("page_id").eqNullSafe(F.col("first_id")))
    n = F.octet_length("payload")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    revisit = F.concat(line("WARC-Refers-To", urn("first_id")), line("X-Payload-Length", n.cast("string")))
    record = F.concat(
        F.lit(MAGIC + CRLF), F.lit("WARC-Type: "), F.when(F.col("response"), "response").otherwise("revisit"), F.lit(CRLF),
        line("WARC-Record-ID", urn("page_id")), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit(f"WARC-Date: {date}{CRLF}"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.when(F.col("response"), "").otherwise(revisit),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF), line("Content-Length", F.when(F.col("response"), n).otherwise(0).cast("string")),
        F.lit(CRLF), F.when(F.col("response"), F.col("payload")).otherwise(""),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _scan(batches):
    """Segments in file order -> every candidate record that ends within its file, with its payload.

    A false candidate is inside a payload, so several may be open at once; they share one buffer.
    """
    rows: list[tuple] = []
    held = 0
    file, off, base, buffer, waiting = None, 0, 0, bytearray(), []
    for batch in batches:
        for name, block, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block:
                raise ValueError("an archive was split: store it compressed, as one unit")
            if name != file:
                file, off, waiting = name, 0, []
                buffer.clear()
            if waiting:
                buffer += seg + END.encode()
            end = off + len(seg) + len(END)
            start = 2 if seg.startswith(CRLF.encode()) else 0  # a payload's last CRLF reads as part of the terminator before it
            if seg.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), start) and (found := _LENGTH.search(seg)):
                if not waiting:
                    base = end
                    buffer.clear()
                waiting.append((off + start, end, int(found[1]), seg[start:]))
            off = end
            still = []
            for record in waiting:
                at, body, length, head = record
                if body + length > end:
                    still.append(record)
                    continue
                rows.append((file, at, body + length + len(END), head.decode("utf-8", "replace"), bytes(buffer[body - base : body - base + length])))
                held += length
            waiting = still
            if held > 1 << 22 or len(rows) >= 1000:
                yield _records(rows)
                rows, held = [], 0
    yield _records(rows)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "off", "next", "head", "payload"])


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, off, next, head, payload of every candidate: a place where a record may start, and where its successor would.

    One pass in file order, without a shuffle. Archives are compressed files, which
    Spark reads as one unit each; the writer bounds their size.
    """
    try:
        lines = spark.read.option("lineSep", END).text(path)
    except AnalysisException as empty:  # a folder without files
        if "UNABLE_TO_INFER_SCHEMA" not in str(empty):
            raise
        return spark.createDataFrame([], "file long, off long, next long, head string, payload binary")
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("seg"))
    return lines.mapInArrow(_scan, "file long, off long, next long, head string, payload binary")


def _field(name: str):
    return F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def reachable(found: DataFrame) -> DataFrame:
    """The candidates' (file, off) that the chain from each file's start reaches."""
    spark = found.sparkSession
    links = written(found.select("file", "off", "next"), "warc-links")
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    jump = links.join(links.select("file", F.col("off").alias("next")), ["file", "next"]).select("file", "off", "next")
    reached, path = links.filter("off = 0").select("file", "off"), new_path(spark, "warc-reached")
    reached.write.parquet(path)
    for k in range(max(0, most - 1).bit_length()):
        if k:  # steps of 2**k records
            jump = jump.join(jump.select("file", F.col("off").alias("next"), F.col("next").alias("beyond")), ["file", "next"]).select("file", "off", F.col("beyond").alias("next"))
        jump = written(jump, "warc-jump")
        step = spark.read.schema(reached.schema).parquet(path).join(jump, ["file", "off"]).select("file", F.col("next").alias("off"))
        step.write.mode("append").parquet(path)  # disjoint: what had been reached is one whole run of the chain
    return spark.read.schema(reached.schema).parquet(path)


def verified(found: DataFrame) -> DataFrame:
    """The candidates (file, off, next and more) that are records: the ones a chain from its file's start reaches."""
    found = written(found, "warc-candidates")
    return found.join(reachable(found), ["file", "off"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, off, next, head, payload of every record."""
    return verified(scan_archives(spark, path))


def page_records(records: DataFrame) -> DataFrame:
    """file, off, next, and what the (candidate) records say of each page; payloads are read here and not carried on."""
    response = _field("WARC-Type") == "response"
    number = lambda name: F.regexp_extract(F.coalesce(_field(name), F.lit("")), r"urn:page:(-?[0-9]+)", 1).try_cast("bigint")
    return records.select(
        "file", "off", "next", number("WARC-Record-ID").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(_field("X-Payload-Length").try_cast("bigint")).cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")).alias("payload_digest"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, number("WARC-Refers-To")).alias("refers_to"),
    )


def op6_warc_round_trip(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return verified(page_records(scan_archives(spark, path))).drop("file", "off", "next")


OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
chars AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id,
    list_aggregate(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS digest
  FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM chars
"""
