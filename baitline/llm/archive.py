"""Content-addressed WARC archive.

``write_archive`` keeps two tables in a folder: ``headers`` holds the exact header bytes
of every record with the digest of its payload, ``payloads`` holds each distinct payload
once, under its SHA-256. ``read_records`` joins the two, recomputes every stored digest
and length, and gives the records' bytes back; a payload that is missing or does not
match its digest stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm.tables import shared_folder, table

#: Shorter payloads are stored as responses of their own, never as revisits.
SHORTEST_REVISITED = 100
CAPTURED_AT = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))


def _record_uri(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    marks = F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 16)
    return F.concat(
        F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), marks, F.lit(":"),
        F.substring(digest, 1, 16), F.lit(":"), copy.cast("string"),
    )


def record_headers(pages: DataFrame, captured_at: str = CAPTURED_AT) -> DataFrame:
    """(page_id, digest, stored, header) of every page row; ``stored`` tells whether the payload belongs to the record.

    Of equal payloads of at least 100 bytes the row with the smallest page_id is the
    response (null page_ids come last, then the smaller url, nulls first); if that row is
    repeated, one of the copies is. All others are revisits that refer to it. A null html
    is an empty payload, a null url an empty target; line breaks in urls are written
    percent-encoded. Identical rows are counted before they are dealt out again, and what
    is compared by digest are rows without their payloads.
    """
    payload = _payload(F.col("html"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    ).groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url")
    leaders = rows.filter(F.col("bytes") >= SHORTEST_REVISITED).groupBy("digest").agg(F.min(place).alias("leader"))
    dealt = rows.join(leaders, "digest", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    own = _record_uri(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))
    first = _record_uri(F.col("leader.page_id"), F.col("leader.url"), F.col("digest"), F.lit(1))
    revisit = F.col("leader").isNotNull() & ~((own == first) & F.col("leader").eqNullSafe(place))
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF), _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF),
    )
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))), _line("WARC-Date", captured_at),
        _line("WARC-Target-URI", target), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(
            revisit, F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", F.concat(F.lit("<"), first, F.lit(">")))),
        ).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", length.cast("string")), F.lit(CRLF), http,
    )
    return dealt.select("page_id", "digest", (~revisit).alias("stored"), header.alias("header"))


def distinct_payloads(pages: DataFrame) -> DataFrame:
    """Each distinct payload once, with its digest; copies within a task are merged before the shuffle."""
    payload = _payload(F.col("html"))
    return pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(
        F.first("payload").alias("payload"),
    )


def write_archive(pages: DataFrame, folder: str, captured_at: str = CAPTURED_AT) -> None:
    """Write ``folder/headers`` and ``folder/payloads`` for pages (page_id, url, html); other columns are left out."""
    record_headers(pages, captured_at).write.parquet(f"{folder}/headers")
    distinct_payloads(pages).write.parquet(f"{folder}/payloads")


def _checked_payloads(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    failure = F.raise_error(F.concat(F.lit("stored payload does not match its digest "), F.col("digest")))
    return stored.select("digest", F.when(right, F.col("payload")).otherwise(failure.cast("binary")).alias("payload"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archive: its header text, payload (null for revisits) and exact bytes.

    Only records that hold their payload meet the payload table with its bytes; revisits
    meet its digests alone. Either way a digest without a stored payload stops the job.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = _checked_payloads(spark, folder)
    missing = F.raise_error(F.concat(F.lit("no payload for digest "), F.col("digest")))
    full = headers.filter("stored").join(payloads, "digest", "left").select(
        "header", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(missing.cast("binary")).alias("payload"),
    )
    known = spark.read.parquet(f"{folder}/payloads").select("digest", F.lit(True).alias("known"))
    bare = headers.filter("NOT stored").join(known, "digest", "left").select(
        F.when(F.col("known"), F.col("header")).otherwise(missing.cast("string")).alias("header"), F.lit(None).cast("binary").alias("payload"),
    )
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    body = F.coalesce("payload", F.encode(F.lit(""), "UTF-8"))
    return full.unionByName(bare).withColumn("record", F.concat(F.encode("header", "UTF-8"), body, end))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def _page(uri: Column) -> Column:
    page = F.regexp_extract(uri, "urn:page:([^:]*):", 1)
    return F.when(page.rlike("^-?[0-9]+$"), page.cast("long"))


def record_fields(records: DataFrame) -> DataFrame:
    """What the record bytes say: (page_id, record_type, refers_to, payload_digest, payload_bytes).

    The payload is cut out of the record's bytes by its two Content-Length values, and for
    responses digest and length are taken from it.
    """
    head = F.length(F.encode("header", "UTF-8"))
    split = records.withColumn("content", F.substring("record", head + 1, F.octet_length("record") - head - 2 * len(CRLF)))
    kind = _field("WARC-Type")
    declared = F.substring_index(_field("WARC-Payload-Digest"), "sha256:", -1)
    http_length = F.regexp_extract("header", "Content-Length: ([0-9]+)\r\n\r\n$", 1).cast("long")
    return split.select(
        _page(_field("WARC-Record-ID")).alias("page_id"), kind.alias("record_type"), _page(_field("WARC-Refers-To")).alias("refers_to"),
        F.when(kind == "response", F.sha2("content", 256)).otherwise(declared).alias("payload_digest"),
        F.when(kind == "response", F.octet_length("content").cast("long")).otherwise(http_length).alias("payload_bytes"),
    )


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages table as an archive in the shared folder and read it back."""
    folder = shared_folder(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return record_fields(read_records(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
    )
