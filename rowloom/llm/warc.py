"""A content-addressed web archive.

Payload bytes are stored once for each SHA-256 digest; the exact bytes of each record's header are kept
apart. Of records with equal payloads of at least ``least`` bytes, that of the largest id is a response
and the others revisit it; smaller payloads are all responses. Reading back recomputes the digests of
the stored payloads and stops at a difference; whole records are put together by a join.

Cases: a null payload is empty; a null url is left out of the header, control characters and spaces in
a url are percent-encoded; repeated rows give repeated records (with the largest id, all are
responses); rows without id are never the response unless no other has the payload. Extra columns are
not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import col, written
from rowloom.llm.registry import query, table
from rowloom.session import ensure_checkpoint_dir

#: The alphabet of base 32 (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: each five digits are four characters."""
    parts = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(hex_, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record_id(id_: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def _header(revisit: Column) -> Column:
    def line(name: str, value: Column | str) -> Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    url = F.col("u")
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    none = F.lit(None).cast("string")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("k"))),
        line("WARC-Date", DATE),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE)).otherwise(none)),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("owner"))).otherwise(none)),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Write the tables ``payloads (digest, payload)`` and ``headers (digest, header)`` under ``path``."""
    body = F.coalesce(F.encode(col(payload).cast("string"), "UTF-8"), F.lit(b""))
    base = pages.select(col(id).alias("k"), col(url).alias("u"), body.alias("b")).withColumn("digest", F.unhex(F.sha2("b", 256)))
    narrow = written(base.select("k", "u", "digest", F.sha1("b").alias("sha1"), F.octet_length("b").cast("long").alias("size")), "records")
    owners = written(narrow.groupBy(F.col("digest").alias("d")).agg(F.max("k").alias("owner")), "owners")
    revisit = (F.col("size") >= least) & ~F.col("k").eqNullSafe(F.col("owner"))
    headers = narrow.join(owners, F.col("digest") == F.col("d"))
    headers.select("digest", F.encode(_header(revisit), "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    # joined by a name that is never null, so that the distinct rows need no second shuffle
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    wanted = owners.select("d", name("owner").alias("o"))
    once = base.withColumn("name", name("k")).join(wanted, (F.col("digest") == F.col("d")) & (F.col("name") == F.col("o")), "left_semi")
    once.select("digest", "name", "b").dropDuplicates(["digest", "name"]).select("digest", F.col("b").alias("payload")).write.option(
        "compression", "zstd").parquet(f"{path}/payloads")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("digest binary, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    sure = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary"))
    return headers, payloads.select("digest", sure.alias("payload"))


def _field(name: str) -> Column:
    value = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def _page(name: str) -> Column:
    found = F.regexp_extract(_field(name), "^<urn:x-page:(.*)>$", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Each record as its header says, and the length and digest found in the stored payload."""
    headers, payloads = _tables(spark, path)
    facts = payloads.select(F.col("digest").alias("d"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    facts = written(facts.withColumn("payload_digest", base32(F.col("sha1"))), "facts")
    found = headers.join(facts, F.col("digest") == F.col("d"))
    said = F.substring(_field("WARC-Payload-Digest"), 6, 32)
    digest = F.when(said == F.col("payload_digest"), said).otherwise(F.raise_error(F.lit("a header differs from its payload")))
    return found.select(
        _page("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), "payload_bytes", digest.alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record``: the bytes of each record; ``payload``: those of the page, also for revisits."""
    headers, payloads = _tables(spark, path)
    own = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat("header", own, F.lit(b"\r\n\r\n"))
    return headers.join(payloads, "digest").select(_page("WARC-Record-ID").alias("page_id"), record.alias("record"), "payload")


_BASE32_SQL = " || ".join(
    f"'{BASE32}'[((('0x' || substr(h, {i + 1}, 5))::BIGINT >> {s}) & 31) + 1]" for i in range(0, 40, 5) for s in (15, 10, 5, 0))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, payload_bytes, {_BASE32_SQL} AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM q
"""


@query("op6_warc", OP6_SQL)
def op6_warc(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/rowloom-{uuid.uuid4().hex}-archive"
    write_archive(table(spark, sf_dir, "pages"), path)
    found = read_records(spark, path)
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
