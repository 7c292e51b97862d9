"""Content-addressed WARC archive: payload bytes once per strong digest, exact record headers beside them.

``write_archive`` fills three tables in the shared folder: facts of each page, payloads by SHA-256, and record headers.
``read_archive`` puts the original records together again by joins and checks every digest on the way; a digest
that does not fit its bytes, or two payloads under one address, is an error. ``cut_payload`` finds the payload in the bytes of a
record by the lengths that stand in it, as any reader of the format would.

A response record holds an HTTP response, headers first, as the format asks; its payload is the page. A revisit holds none. Record ids
name the page and a number of the row, so that they differ for repeated rows and rows without an id. Copies of a payload are combined before
the shuffle, and the joins on the address are plain ones, which adaptive execution splits where one payload is
behind a large part of the pages.

Defined results: null html is an empty payload; a null url gives no target line; a null date is the one given for all; line breaks in a url are percent-encoded.
A null page id sorts below all others. Repeated rows are records of their own; those that carry the page id
of the response are responses too. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Steps

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    headers: DataFrame  # page_id, address, header
    payloads: DataFrame  # address, payload


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, least_revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z",
                  date_column: str | None = None) -> Archive:
    """Of equal payloads of at least ``least_revisit_bytes``, the largest page id is the response, others revisit it.

    Records carry the time in ``date_column`` (a timestamp), or ``date`` where that is null or not given.
    """
    when = F.lit(None).cast("string") if date_column is None else F.date_format(F.col(date_column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(
        F.col("page_id"), F.coalesce(when, F.lit(date)).alias("date"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("address", F.unhex(F.sha2("payload", 256)))
    with Steps(pages.sparkSession) as steps:
        # The number of a row is stored with it, and so is the same for all that read it.
        facts = steps.store(rows.select("page_id", "date", "url", "address", F.sha1("payload").alias("sha1"),
                                        F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")), "warc-facts")
        one = facts.groupBy("address").agg(
            F.max(F.struct("page_id", "row")).alias("keeper"), F.min("sha1").alias("low"), F.max("sha1").alias("high"),
            F.min("bytes").alias("least"), F.max("bytes").alias("most"))
        one = one.select("address", "keeper", F.assert_true(
            (F.col("low") == F.col("high")) & (F.col("least") == F.col("most")), "two payloads under one address").alias("ok"))
        revisit = (F.col("bytes") >= least_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper.page_id"))
        urn = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))
        url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        http = F.when(revisit, "").otherwise(F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2)))
        header = F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            _line("WARC-Record-ID", urn(F.col("page_id"), F.col("row"))),
            _line("WARC-Date", F.col("date")),
            _line("WARC-Target-URI", url),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            _line("WARC-Refers-To", F.when(revisit, urn(F.col("keeper.page_id"), F.col("keeper.row")))),
            _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
            _line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.length(http) + F.col("bytes")).cast("string")),
            F.lit(CRLF), http)
        headers = steps.store(facts.join(one, "address").where("ok IS NULL").select(
            "page_id", "address", F.encode(header, "UTF-8").alias("header")), "warc-headers")
        payloads = steps.store(rows.groupBy("address").agg(F.first("payload").alias("payload")), "warc-payloads")
        steps.drop(facts)
        steps.sweep()
    return Archive(headers, payloads)


def read_archive(archive: Archive) -> DataFrame:
    """(page_id, record_type, refers_to, target, date, digest, payload, record): whole records, parsed from their own bytes.

    ``payload`` is what the record stands for: cut out of its bytes, or for a revisit the payload of the record that it refers to.
    """
    sound = F.assert_true(F.unhex(F.sha2("payload", 256)) == F.col("address"), "a payload does not fit its address")
    checked = archive.payloads.select("address", F.col("payload").alias("stored"), sound.alias("sound"))
    whole = archive.headers.join(checked, "address").where("sound IS NULL")
    head = F.decode("header", "UTF-8")
    number = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit("")).cast("long")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    whole = whole.select(
        number(r"\r\nWARC-Record-ID: <urn:page:(-?\d+):\d+>").alias("page_id"), F.regexp_extract(head, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        number(r"\r\nWARC-Refers-To: <urn:page:(-?\d+):\d+>").alias("refers_to"),
        F.regexp_extract(head, r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1).alias("target"),
        F.regexp_extract(head, r"\r\nWARC-Date: ([^\r\n]*)\r\n", 1).alias("date"),
        F.regexp_extract(head, r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n", 1).alias("digest"), "header", "stored")
    revisit = F.col("record_type") == "revisit"
    records = whole.select("*", F.when(revisit, F.concat("header", end)).otherwise(F.concat("header", "stored", end)).alias("record"))
    return records.select("page_id", "record_type", "refers_to", "target", "date", "digest",
                          F.when(revisit, F.col("stored")).otherwise(cut_payload(F.col("record"))).alias("payload"), "record")


def cut_payload(record: Column) -> Column:
    """The payload of a response record: behind its two heads, as long as its lengths say; null if they don't fit together."""
    # The bytes as they are, taken for a string: looking for a stretch of bytes in it does not care whether they are text.
    text = record.cast("string")
    head = F.substring_index(text, CRLF * 2, 1)
    block = F.octet_length(head) + 5
    http = F.octet_length(F.substring_index(text, CRLF * 2, 2)) + 5  # where the payload begins
    length = F.regexp_extract(head, r"\r\nContent-Length: (\d+)", 1).try_cast("int")
    fits = F.octet_length(record) == block + length + 3
    return F.when(fits & (http <= block + length), F.substring(record, http, block + length - http))


def digest_archive(records: DataFrame) -> DataFrame:
    """One row per record: length and SHA-1 of the payload as read, the latter held against the header."""
    digest = F.sha1("payload")
    same = F.assert_true(digest == F.col("digest"), "a payload does not fit its record")
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", "refers_to", same.alias("same")).where("same IS NULL").drop("same")
