"""Content-addressed archive of web records.

`write_archive` stores two tables: `payloads`, each distinct payload once under its SHA-256 digest, and
`headers`, the exact header bytes of every record with the digest of its payload. `read_archive` joins
them into the original records. A payload seen before is written as a `revisit` record that refers to the
record holding it: of the records with equal payloads, that with the smallest page id is the `response`.

Digests are verified twice: a digest whose rows disagree in length or SHA-1 stops the writing, and every
payload read back is hashed again.

Defined results: a null payload counts as empty; a null url gives an empty target; null page ids are never
smallest, and records without any id among equal payloads are all responses, as are rows that repeat the
smallest id. Payloads shorter than `least_bytes` are always responses. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

END = "\r\n"
# The digits of base 32 as Spark's conv writes them, and as digests are written.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_LINES = ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8")


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 160-bit digest given in hex: five hex digits make four of base 32."""
    blocks = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*blocks), CONV_DIGITS, BASE32_DIGITS)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _lines(*lines: Column | str) -> Column:
    parts = [F.concat(line if isinstance(line, Column) else F.lit(line), F.lit(END)) for line in lines]
    return F.concat(*parts, F.lit(END))


def with_headers(records: DataFrame) -> DataFrame:
    """Exact header bytes: the record's own lines and, after an empty line, the HTTP lines of the payload."""
    http = _lines(*HTTP_LINES, F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")))
    is_revisit = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= F.col("least_bytes")) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    block = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    refers = F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id")), F.lit(END))).otherwise("")
    warc = F.concat(
        F.lit("WARC/1.1" + END + "WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise("response"), F.lit(END),
        F.lit("WARC-Record-ID: "), _record_id(F.col("page_id")), F.lit(END),
        F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " "), F.lit(END), refers,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(END),
        F.lit("Content-Type: application/http; msgtype=response" + END + "Content-Length: "), block.cast("string"), F.lit(END + END),
    )
    return records.withColumn("header", F.concat(warc, http).cast("binary"))


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> None:
    """Write one record per row of `df` below `path`."""
    rows = df.select(
        F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumns({
        "digest": F.unhex(F.sha2("payload", 256)), "sha1": base32_of_hex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("bigint"),
    })
    groups = rows.groupBy("digest").agg(
        F.min("page_id").alias("first_id"),
        F.assert_true(
            (F.min("sha1") == F.max("sha1")) & (F.min("payload_bytes") == F.max("payload_bytes")), F.lit("different payloads share a digest")
        ).alias("checked"),
    )
    records = rows.drop("payload").join(groups.where(F.col("checked").isNull()).drop("checked"), "digest").withColumn("least_bytes", F.lit(least_bytes))
    with_headers(records).select("digest", "header").write.parquet(f"{path}/headers")
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Original records: `header`, `payload` (also for revisits), `record` (the bytes of the record), `verified`."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    payloads = payloads.withColumn("verified", F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    joined = headers.join(payloads, "digest")
    body = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", "payload", F.concat("header", body, F.lit((END + END).encode())).alias("record"), "verified")


def _field(name: str) -> Column:
    """Value of a header line, empty if there is none."""
    return F.regexp_extract(F.decode("header", "utf-8"), rf"\r\n{name}: ([^\r\n]*)", 1)


def archive_report(records: DataFrame) -> DataFrame:
    """One row per record read back: id, type, size and digest of the payload, and the record it refers to."""
    number = lambda name: F.nullif(F.regexp_extract(_field(name), r"<urn:page:(-?\d+)>", 1), F.lit("")).cast("bigint")
    sound = F.assert_true(F.col("verified"), F.lit("a payload read back does not match its digest"))
    return records.where(sound.isNull()).select(
        number("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"), _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), F.octet_length("record").cast("bigint").alias("record_bytes"),
    )
