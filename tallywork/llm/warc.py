"""Content-addressed web archive: payloads once by digest, exact record heads apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.common import page_texts

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_lengths(archive: DataFrame) -> DataFrame:
    """(page_id, body_bytes, record_bytes, head_says, record_digest) of each record of :func:`read_archive`, put together by its join.

    ``body_bytes`` counts the payload in the rebuilt record, none for a revisit. ``record_bytes`` counts the rebuilt record without the two line breaks at its end, ``head_says`` the bytes of its WARC
    head and of the block whose length that head names: they are equal in a sound archive. ``record_digest`` is the record's SHA-256.
    """
    warc_head = F.octet_length(F.substring_index("head", CRLF + CRLF, 1)) + 4
    return archive.select(
        "page_id", (F.octet_length("record") - 4 - F.octet_length("head")).cast("long").alias("body_bytes"),
        (F.octet_length("record") - 4).cast("long").alias("record_bytes"),
        (warc_head + _header("Content-Length").cast("long")).alias("head_says"), F.sha2("record", 256).alias("record_digest"))


def _record_id(page_id: Column, digest: Column) -> Column:
    """A URN made of page and payload, so that a reference can be written without looking it up."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    parts = [h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header_value(text: Column) -> Column:
    """Line breaks inside a value would start a new header line."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def archive_pages(
    pages: DataFrame, folder: str, captured_at: str = "1970-01-01T00:00:00Z", least_revisit_bytes: int = 100
) -> None:
    """Write a WARC record for each row of ``pages(page_id, url, html)`` below ``folder``.

    ``folder/payloads`` holds (digest, payload): each distinct payload once, under its SHA-256.
    ``folder/records`` holds (page_id, digest, head): the exact bytes of each record up to its payload
    (WARC head and HTTP head), as text. :func:`read_archive` joins both.

    Of equal payloads of at least ``least_revisit_bytes`` bytes the smallest page_id is a ``response``,
    the others are ``revisit`` records that refer to it; shorter ones are all responses. Missing html is an
    empty payload, a missing url leaves its header line out. A missing page_id counts as larger than any
    other; if a payload has no other, all its rows are responses. Rows that repeat the smallest page_id with
    the same payload are all responses. An empty table gives an empty archive.

    Two passes over the pages. The first groups payloads by digest, equal ones already within a task, and
    fails if two payloads of one digest differ in length or in a second hash. The second shuffles
    (page_id, url, digest) only; skewed digests are split by adaptive execution, since the other side of that
    join has one row a digest.
    """
    payload = F.encode("html", "utf-8")
    rows = page_texts(pages, "url").select(
        "page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    length, second = F.octet_length("payload"), F.xxhash64("payload")
    stored = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        (F.min(length) == F.max(length)).alias("same_length"), (F.min(second) == F.max(second)).alias("same_hash"))
    stored.select("digest", F.when(F.col("same_length") & F.col("same_hash"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("different payloads of digest "), F.col("digest"))).cast("binary")).alias("payload"),
    ).write.mode("errorifexists").parquet(f"{folder}/payloads")

    index = rows.select("page_id", "url", "digest", length.alias("bytes"))
    first = index.filter(F.col("bytes") >= least_revisit_bytes).groupBy("digest").agg(
        F.min("page_id").alias("response_id"))
    joined = index.join(first, "digest", "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block_bytes = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {captured_at}"),
        F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(F.col("revisit"), F.concat(
            F.lit("WARC-Refers-To: "), _record_id(F.col("response_id"), F.col("digest")))),
        F.when(F.col("revisit"), F.concat(F.lit("Refers-To-Page: "), F.col("response_id").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block_bytes.cast("string")),
    ]
    head = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), F.col("http"))  # concat_ws leaves nulls out
    joined.withColumns({"revisit": revisit, "http": http}).select("page_id", "digest", head.alias("head")).write.mode(
        "errorifexists").parquet(f"{folder}/records")


def _header(name: str) -> Column:
    """The value of a header line of the WARC head, null where there is none.

    Values hold no line break, so a line that starts with the name is the header itself.
    """
    found = F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records below ``folder``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, head,
    payload, record.

    Type, reference and url are read from the stored head. Length and digest are those of the stored
    payload, which is hashed again; a payload that doesn't have its digest fails the read. A revisit's payload
    is that of its response; ``record`` is the whole WARC record, in which a revisit has none. Columns that the
    caller leaves out are not carried through the join.
    """
    records = spark.read.schema("page_id long, digest string, head string").parquet(f"{folder}/records")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload isn't that of digest "), F.col("digest"))).cast("string"))
    stored = payloads.select(
        "digest", "payload", verified.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    parsed = records.select(
        "page_id", "digest", "head", _header("WARC-Target-URI").alias("url"), _header("WARC-Type").alias("record_type"),
        _header("Refers-To-Page").cast("long").alias("refers_to"))
    return parsed.join(stored, "digest").select(
        "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "head", "payload",
        F.concat(F.encode("head", "utf-8"), body, F.lit(b"\r\n\r\n")).alias("record"))
