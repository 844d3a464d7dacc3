"""Content-addressed WARC archive.

``write`` keeps two tables in the shared folder: payload bytes once per SHA-256 digest, and the
exact header block of every record. Records with equal payloads of at least ``min_revisit_bytes``
bytes form one response (the largest id) and revisits of it. ``read`` joins headers with payloads
by digest, checks both digests against the bytes and rebuilds every record.

A digest stands for a payload only if lengths and SHA-1 of all its rows agree as well; the write
fails otherwise. Copies are combined before the shuffle, so a payload that a third of all pages
share moves once per task; rebuilding is a join whose hot side adaptive execution can split.

Defined cases: a null payload is empty; rows of one id and one payload are one and the same record
and get the same type; a null id is a response only of payloads that no other id has; line breaks
in a URL are percent-encoded; a null URL is empty; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phishlake.sources.workdir import work_dir

BREAK = "\r\n"


@dataclass(frozen=True)
class Archive:
    payloads: str
    headers: str


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 (RFC 4648, no padding needed) of a digest of whole 5-byte groups in hex."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(fields: list[tuple[str, Column | str]], block_bytes: Column) -> Column:
    parts = [F.lit("WARC/1.1" + BREAK)]
    for name, value in [*fields, ("Content-Length", block_bytes.cast("string"))]:
        line = F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(BREAK))
        parts.append(F.coalesce(line, F.lit("")))
    return F.concat(*parts, F.lit(BREAK))


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
          min_revisit_bytes: int = 0, folder: str | None = None) -> Archive:
    """Write the archive of all rows; returns where its two tables are."""
    folder = folder or work_dir(pages.sparkSession, "warc")
    archive = Archive(f"{folder}/payloads", f"{folder}/headers")
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({
        "digest": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    same = (F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes"))
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), same.alias("same")).select(
        "digest", F.when(F.col("same"), F.col("payload")).otherwise(
            F.raise_error(F.lit("different payloads share a digest"))).alias("payload"))
    stored.write.option("compression", "zstd").parquet(archive.payloads)

    narrow = rows.select("id", "url", "digest", "sha1", "bytes")
    first = narrow.groupBy("digest").agg(F.max("id").alias("response"))
    typed = narrow.join(first, "digest").withColumn(
        "revisit", (F.col("bytes") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("response")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(BREAK + BREAK))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    fields: list[tuple[str, Column | str]] = [
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", name), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(
            F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">")))),
        ("WARC-Profile", F.when(F.col("revisit"), F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    block = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    typed.select("id", "digest", F.concat(_header(fields, block), http).alias("header")).write.option(
        "compression", "zstd").parquet(archive.headers)
    return archive


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """(id, header, payload, record): every record, bytes as they would stand in a WARC file.

    ``record`` leaves a revisit's payload out, as the format asks; ``payload`` has it all the same.
    """
    headers = spark.read.schema("id long, digest binary, header string").parquet(archive.headers)
    stored = spark.read.schema("digest binary, payload binary").parquet(archive.payloads)
    whole = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = stored.select("digest", F.when(whole, F.col("payload")).otherwise(
        F.raise_error(F.lit("stored payload does not match its digest"))).alias("payload"))
    body = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(checked, "digest", "left").select(
        "id", "header", "payload",
        F.concat(F.encode("header", "UTF-8"), body, F.lit((BREAK + BREAK).encode())).alias("record"))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)


def summary(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_bytes) of rebuilt records.

    The digest comes from the rebuilt bytes and must be the one in the header.
    """
    digest = base32(F.sha1("payload"))
    return records.select(
        F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest), digest).otherwise(
            F.raise_error(F.lit("payload does not match its record"))).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract("header", r"(?m)^WARC-Refers-To: <urn:page:(-?\d+)>", 1), F.lit("")).cast("long").alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"))
