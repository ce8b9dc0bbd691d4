"""Derivative records of web responses: metadata and plain-text conversions.

Each response gives one `metadata` and one `conversion` record. Both name the response
they come from (`WARC-Refers-To`, its URI, date and digests), so that a derivative can
be traced to its source without it. All work is built-in expressions on one row: no
shuffle, and a record is as large as its page.

Values: a null or empty page gives an empty conversion; a null URL leaves its header
out; repeated responses give repeated records with equal identifiers; an empty table
gives no records. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"

# The five entities of XML, and the no-break space.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
]
# Elements whose content is no text, and those that end a line.
HIDDEN = ["script", "style", "noscript", "template"]
BLOCKS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main"
    "|nav|ol|p|pre|section|table|td|th|title|tr|ul"
)
_BLANK = r"[\t-\r ]"


def plain_text(html: Column) -> Column:
    """Text of a page: hidden elements and comments out, block elements as line ends."""
    text = F.coalesce(html, F.lit(""))
    text = F.regexp_replace(text, r"(?s)<!--.*?(-->|\z)", " ")
    for element in HIDDEN:
        text = F.regexp_replace(text, rf"(?is)<{element}\b[^>]*>.*?(</{element}{_BLANK}*>|\z)", " ")
    text = F.regexp_replace(text, rf"{_BLANK}+", " ")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"</?[A-Za-z!][^>]*>", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.regexp_replace(text, r"\A[ \n]+|[ \n]+\z", "")


def page_title(html: Column) -> Column:
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title", 1)
    return F.trim(F.regexp_replace(found, rf"{_BLANK}+", " "))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "utf-8"), 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made of its parts, the same whenever they are."""
    known = [F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]
    h = F.sha2(F.concat_ws("\u0001", *known), 256)
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
              F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of a table of pages (page_id, url, html) fetched at `date`."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    length = F.octet_length(payload)
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        length.cast("string"), F.lit(CRLF),
    )
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id"), F.col("url"), payload).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        payload.alias("payload"),
    )


def _header(name: str, value: Column) -> Column:
    """A header line, or null (which concat_ws leaves out) without a value."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(CRLF))


def derivatives(source: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two records per response (record_id, target_uri, date, http_headers, payload).

    Returns the columns `keep` of the source and, per record, `record_type`, `record_id`,
    `refers_to`, `target_uri`, `date`, `content_type`, `source_headers`,
    `source_payload_digest`, `block`, `block_digest`, `content_length` and `headers` (the
    record's own header lines). The two records of a response name each other through
    `refers_to`, and the metadata names its conversion.
    """
    kept = [c for c in keep or [] if c in source.columns]
    one = source.select(
        *kept,
        F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.coalesce("http_headers", F.lit("")).alias("source_headers"),
        digest(F.coalesce("payload", F.lit(""))).alias("source_payload_digest"),
        digest(F.concat(F.coalesce("http_headers", F.lit("")), F.lit(CRLF), F.coalesce("payload", F.lit("")))).alias("source_block_digest"),
        plain_text(F.col("payload")).alias("text"), page_title(F.col("payload")).alias("title"),
        record_id(F.lit("conversion"), F.col("record_id")).alias("conversion_id"),
        record_id(F.lit("metadata"), F.col("record_id")).alias("metadata_id"),
    )
    fields = F.concat_ws(
        "",
        _header("title", F.nullif(F.col("title"), F.lit(""))),
        _header("conversion", F.col("conversion_id")),
        _header("source-block-digest", F.col("source_block_digest")),
        _header("source-payload-digest", F.col("source_payload_digest")),
        F.regexp_replace("source_headers", r"([^\r\n]+\r?\n?)", "source-header: $1"),
    )
    pair = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("record_id"),
                 F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"),
                 F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    rows = one.withColumn("_record", F.explode(pair)).select(
        *kept, "_record.*", "refers_to", "target_uri", "date", "source_headers",
        "source_payload_digest",
    )
    rows = rows.withColumn("block_digest", digest(F.col("block")))
    rows = rows.withColumn("content_length", F.octet_length("block").cast("long"))
    headers = F.concat_ws(
        "",
        F.lit(f"{VERSION}{CRLF}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-Date", F.col("date")),
        _header("WARC-Refers-To-Target-URI", F.col("target_uri")),
        _header("WARC-Refers-To-Date", F.col("date")),
        _header("WARC-Block-Digest", F.col("block_digest")),
        _header("Content-Type", F.col("content_type")),
        _header("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.withColumn("headers", headers)


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files in the folder `path`, a file per partition."""
    body = F.concat("headers", F.lit(CRLF), "block")
    writer = records.select(body.alias("value")).write.option("lineSep", CRLF * 2)
    writer.option("compression", "gzip").text(path)
