"""Content-addressed WARC archive, with DataFrame functions only.

Payload bytes are stored once for each SHA-256 digest; the exact header block of every
record is a row of its own; records are rebuilt by joining the two on the digest. A copy
of a payload of ``min_revisit`` bytes or more is a revisit of the record with the
smallest id; smaller payloads are always responses (their bytes are still stored once).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

MIN_REVISIT = 100
#: Fixed values of the format: WARC/1.1, and the profile of revisits that refer to an identical payload.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"


@dataclass
class Archive:
    """headers(record_id, digest, header) and payloads(digest, payload), as Parquet folders."""

    headers: str
    payloads: str


def payloads_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, digest, size. Null text is an empty payload."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))


def with_originals(rows: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """id, url, digest, size, refers_to (null: a response). Rows that share the smallest id are all responses; null ids are never referred to."""
    rows = rows.select("id", "url", "digest", "size")
    first = rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"))
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def header_block() -> Column:
    """The exact header lines of a record; control characters of a URL are percent-encoded, as they would end a line."""
    url = F.coalesce("url", F.lit(""))
    for byte in (13, 10, 9, 32):
        url = F.replace(url, F.lit(chr(byte)), F.lit(f"%{byte:02X}"))
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(END),
    )


def write_archive(rows: DataFrame, headers: str, payloads: str) -> Archive:
    """Writes both tables from rows of payloads_of(). Copies meet before the shuffle: a task sends each digest's bytes once."""
    with_originals(rows).select(F.col("id").alias("record_id"), "digest", F.encode(header_block(), "UTF-8").alias("header")).write.parquet(headers)
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(payloads)
    return Archive(headers, payloads)


def field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_archive(spark, archive: Archive) -> DataFrame:
    """Every original record: header, full payload and what the header says. A stored payload whose digest is not its key fails the read."""
    headers = spark.read.parquet(archive.headers)
    stored = spark.read.parquet(archive.payloads)
    good = F.sha2("payload", 256) == F.col("digest")
    stored = stored.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("stored payload is damaged: "), F.col("digest"))).cast("binary")))
    out = headers.withColumn("digest", F.substring(field("WARC-Payload-Digest"), 8, 64)).join(stored, "digest", "inner")
    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return out.select(page("WARC-Record-ID").alias("id"), "record_id", "header", "payload", "digest", field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("url"))


def record_bytes() -> Column:
    """A record as it stands in a WARC file: header block, block (none for a revisit), two line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header"), block, F.lit((END * 2).encode()))


def archived(pages: DataFrame, **columns) -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads them back. An empty table gives an empty archive."""
    base = scratch(pages.sparkSession, "warc")
    return read_archive(pages.sparkSession, write_archive(payloads_of(pages, **columns), f"{base}/headers", f"{base}/payloads"))
