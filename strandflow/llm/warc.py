"""Content-addressed WARC archive.

``write_archive`` makes one record a page and stores two tables in a folder: ``payloads`` holds each distinct
payload once under its SHA-256 (checked against SHA-1 and size), ``headers`` the exact header bytes of every record
with that SHA-256. ``read_archive`` joins them, rebuilds each record's exact bytes, checks length and digests against
the header and parses the header again.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is a response and
the others are revisits that refer to it; smaller ones are all responses. A response's block is the payload. A revisit
(profile identical-payload-digest) has an empty block and names its response; its payload comes back by the join.
Record identifiers hold the page_id and a number of the record, so that repeated rows have identifiers of their own.

Edge cases: null html is an empty payload, a null URL an empty one; control characters (U+0000 to U+001F, U+007F) in a
URL are written percent-escaped; rows that share page_id and payload are all responses if theirs is the largest page_id
(the revisits refer to one of them); a null page_id is written as "none", read back as null, and never the largest; a
very long payload is one row of one file; an empty table gives an empty archive; other columns are ignored, whatever
their names. A hot payload makes a skewed join key; both sides of each join are written tables, so adaptive execution
splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import plain, scratch_path, stored

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = [*range(32), 127]


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest of a multiple of 5 bytes, four characters from each five hex digits."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def escaped(url: Column) -> Column:
    """Control characters as percent escapes."""
    out = url
    for c in CONTROL:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x1f\x7f]"), out).otherwise(url)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest and header of each page's record."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = plain(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select(F.monotonically_increasing_id().alias("number"), "page_id", "url", F.sha2("payload", 256).alias("digest"), base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    # written first: the numbers stand from then on, and a join with a bare shuffle on both sides can split a hot digest
    rows = stored(rows, "records")
    first = rows.groupBy("digest").agg(F.max(F.struct("page_id", "number")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    first = stored(first.select(F.col("digest").alias("d"), F.col("first.page_id").alias("first_id"), F.col("first.number").alias("first_number")), "copies")
    rows = rows.join(first, F.col("digest") == F.col("d"), "left")
    revisit = (F.col("size") >= least) & (F.col("page_id") < F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    ident = lambda page, number: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), number.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", ident(F.col("page_id"), F.col("number"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", ident(F.col("first_id"), F.col("first_number"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        line("WARC-Target-URI", escaped(F.col("url"))),
        F.lit("\r\n"),
    )
    return rows.select("page_id", "digest", F.encode(header, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write ``headers`` and ``payloads`` under the path."""
    records(pages, least).select("digest", "header").write.parquet(f"{path}/headers")
    body = plain(pages, "html").select(F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    # max of equal payloads: any copy; partial aggregation keeps one a task before the shuffle
    check = F.struct(F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    store = body.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.max("payload").alias("payload"), F.min(check).alias("least"), F.max(check).alias("most"))
    # two payloads under one digest would show in the second digest or the size
    store.select("digest", F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.lit("digest collision"))).alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (all its bytes), payload, payload_bytes, payload_digest, record_type, refers_to; every record is checked."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    joined = headers.join(payloads.select(F.col("digest").alias("d"), "payload"), F.col("digest") == F.col("d"), "left")
    text = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1)
    kind = field("WARC-Type", "([a-z]+)")
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    rows = joined.select(
        F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"),
        "payload",
        field("WARC-Record-ID", "<urn:page:(-?[0-9]+|none):[0-9]+>").try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        kind.alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+):[0-9]+>").try_cast("long").alias("refers_to"),
        ((F.sha2("payload", 256) == F.col("digest")) & (field("Content-Length", "([0-9]+)").cast("long") == F.octet_length(block))).alias("sound"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("said"),
    )
    sound = F.col("sound") & (F.col("said") == F.col("payload_digest"))
    return rows.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record does not match its digest")))).drop("sound", "said")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write an archive to the shared folder and read it back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, least)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
