"""Content-addressed web archive.

An archive is two tables in shared storage. *payloads* holds every different
payload once, named by its SHA-256; *headers* holds the exact header blocks of
every record with the name of its payload. Records come back by joining the two;
on reading, each payload's length and both digests are computed again and a
payload that does not match its name ends the query.

Records are those of WARC 1.1: a response's block is an HTTP header and the payload, a revisit's block the HTTP
header alone, and Content-Length is the block's. Record ids are name-based UUIDs of the page's id, URL, payload
and place, so they are unique, also where ids repeat or are null. ``record_bytes`` gives the archive's
records, ``original_bytes`` every record as a response with its whole payload.

Defined cases: null payload is empty; null ids count as larger than any other;
of rows that repeat an id and a payload one is the response and the others
revisit it; line breaks in a URL are percent-encoded, so that a header stays a line; an empty table
gives an empty archive; payloads of any length are stored whole; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: RFC 4648.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a hexadecimal digest of 160 bits (five digits are four characters)."""
    chars = []
    for i in range(8):
        part = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(_BASE32), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))


def _record_id(*parts: Column) -> Column:
    """A name-based UUID of these values."""
    h = F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts))), 256)
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages under path.

    Of records with equal payloads of at least min_revisit_bytes, the one with the
    smallest id is a response and the others revisit it.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("name", F.sha2("payload", 256))
    # a partial aggregate first: however many copies a payload has, a task sends it once
    stored = rows.groupBy("name").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")
    slim = rows.select("page_id", "url", "name", F.length("payload").cast("long").alias("n"), base32_of_hex(F.sha1("payload")).alias("digest"))
    slim = saved(slim.withColumn("row", F.monotonically_increasing_id()), "warc-rows")
    # one row a payload by a partial aggregate: no group of copies is gathered
    first = slim.groupBy("name").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "row")).alias("first"))
    slim = slim.join(first.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"))
    revisit = (F.col("n") >= min_revisit_bytes) & (F.col("row") != F.col("first.row"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "%0D"), "\n", "%0A")
    # a text id is quoted and escaped, so that no id looks like a null one or ends a line
    text_id = isinstance(pages.schema[id_col].dataType, T.StringType)
    named = lambda c: F.coalesce(F.concat(F.lit('"'), F.url_encode(c), F.lit('"')) if text_id else c.cast("string"), F.lit("none"))
    record = lambda of: _record_id(*(F.col(f"{of}{c}") for c in ("page_id", "url", "row")), F.col("name"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"), _line("Content-Length", F.col("n").cast("string")), F.lit(_CRLF))
    slim = slim.withColumn("http", http)
    block = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n"))
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record("")),
        _line("WARC-Target-URI", clean(F.col("url"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", record("first.")), _line("WARC-Refers-To-Target-URI", clean(F.col("first.url"))), _line("WARC-Profile", F.lit(PROFILE)), _line("Page-Referred-To", named(F.col("first.page_id"))))).otherwise(""),
        _line("Page", named(F.col("page_id"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(_CRLF),
    )
    slim.select("page_id", "name", header.alias("header"), "http").write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    """A header's value; '' where it is absent. URLs hold no line breaks."""
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, header, payload (bytes) and what the header says.

    Payloads are checked against their names before they are joined.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("name")
    stored = stored.select(F.col("name").alias("_name"), F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest")).cast("binary")).alias("payload"))
    headers = spark.read.parquet(f"{path}/headers")
    rows = headers.join(stored, F.col("name") == F.col("_name"))
    referred = _field("Page-Referred-To")
    if isinstance(headers.schema["page_id"].dataType, T.StringType):
        referred = F.when(referred != "none", F.url_decode(F.regexp_extract(referred, '^"(.*)"$', 1)))
    return rows.select(
        "page_id",
        "header",
        "http",
        "payload",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        F.when(F.col("header").contains("\r\nPage-Referred-To: "), referred).alias("refers_to"),
        F.regexp_extract("http", r"\r\nContent-Length: ([0-9]+)\r\n", 1).cast("long").alias("payload_length"),
    )


def digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as recomputed from the records read.

    A header whose digest or length is not its payload's ends the query.
    """
    digest = base32_of_hex(F.sha1("payload"))
    ok = (digest == F.col("payload_digest")) & (F.length("payload") == F.col("payload_length"))
    kind = records.schema["page_id"].dataType.simpleString()
    return records.select(
        "page_id",
        F.when(ok, F.length("payload").cast("long")).otherwise(F.raise_error(F.lit("a header does not match its payload")).cast("long")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        F.expr(f"try_cast(refers_to AS {kind})").alias("refers_to"),
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the archive's record: header, block, and the two line ends after a record. A revisit has no payload."""
    payload = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), payload, F.lit(b"\r\n\r\n")).alias("record"))


def original_bytes(records: DataFrame) -> DataFrame:
    """page_id, url and the original block: the HTTP header and the whole payload, of revisits as well."""
    return records.select("page_id", "url", F.concat(F.col("http").cast("binary"), F.col("payload")).alias("block"))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """The headers, the HTTP header and the payload of one record's bytes; the digest of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split(_CRLF)[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("digest mismatch")
    return fields, http, payload
