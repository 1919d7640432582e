"""A content-addressed web archive: payloads once by strong digest, record headers apart, records by a join.

Payloads are addressed by SHA-256.  Writing checks that all payloads of an address have one length and
one SHA-1; reading puts the records together again and hashes the payload that each one holds.  Headers
are kept exactly as they stand in a WARC record, one row per page, with an identifier of their own.  Of pages
with equal payloads of at least ``least_revisit`` bytes the one with the least id is the response and the
others revisit it.  Payloads lie in buckets by address, so that they move once when written and stay in place when read.

Nulls: a null payload is empty, a null id sorts last and is not in the header, a null address is written as an empty
target.  Ids stand percent-encoded in headers, so that any text comes back.  Rows that are equal in all columns are
records of their own, of which one is the response.  A payload is one value of one row, however long.  An empty
table gives an empty archive.  Columns beside the id, the address and the payload are not read.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.llm.common import lookup, staged

#: Bytes of payloads in a bucket, on average.
BUCKET_BYTES = 32 << 20
_ENDS = "\r\n\r\n"


def base32(digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: 20 bytes are 32 letters of five bits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    # Five bytes at a time fit a number of 40 bits.
    parts = [F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    shown = [F.substring(letters, F.shiftright(p, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for p in parts for j in range(8)]
    return F.concat(*shown)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def _field(name: str) -> Column:
    """A field of a header, null where it has none."""
    pattern = rf"\r\n{name}: ([^\r]*)\r\n"
    return F.when(F.col("header").rlike(pattern), F.regexp_extract("header", pattern, 1))


def _record_id(doc: Column, tag: Column) -> Column:
    """An identifier that no two records of an archive share: ``tag`` is the row's own number."""
    told = F.concat_ws("|", F.hex("address"), tag.cast("string"), doc.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(told.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archive(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url: str = "url", payload: str = "html", least_revisit: int = 0, date: str | None = None
) -> None:
    """Writes ``folder``/payloads (address, bytes; in buckets) and ``folder``/records (id, header, address).

    ``date`` is the date of all records, by default that of writing.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    source = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), body.alias("payload"), F.unhex(F.sha2(body, 256)).alias("address")
    )
    facts = source.select("page_id", "url", "address", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    rows = staged(facts.withColumn("tag", F.monotonically_increasing_id()), "warc-rows")
    # Pages of one id and payload first, then all of a payload.
    both = [F.count("*").alias("n"), F.min("tag").alias("tag"), F.min("sha1").alias("s1"), F.max("sha1").alias("s2"), F.min("size").alias("z1"), F.max("size").alias("z2")]
    same = rows.groupBy("address", "page_id").agg(*both)
    head = F.struct(F.col("page_id").isNull().alias("null"), F.col("page_id").alias("id"), "tag", F.col("n").alias("like"))
    firsts = staged(same.groupBy("address").agg(F.min(head).alias("head"), F.sum("n").alias("n"), F.min("s1").alias("s1"), F.max("s2").alias("s2"), F.min("z1").alias("z1"), F.max("z2").alias("z2")), "warc-addresses")
    if not firsts.where("s1 <> s2 or z1 <> z2").isEmpty():
        raise ValueError("different payloads have one address")

    found = lookup(rows, firsts.select("address", "n", F.col("head.tag").alias("first_tag"), F.col("head.id").alias("first_id")), "address", "n")
    revisits = (F.col("tag") != F.col("first_tag")) & (F.col("size") >= least_revisit)
    shown = lambda doc: F.url_encode(doc.cast("string"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("tag"))),
        _line("WARC-Date", F.lit(date)),
        # Line ends in an address would end the field.
        _line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.hex("sha1")))),
        F.coalesce(_line("Page-ID", shown(F.col("page_id"))), F.lit("")),
        F.when(revisits, F.concat(
            _line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("first_tag"))),
            F.coalesce(_line("Page-Refers-To", shown(F.col("first_id"))), F.lit("")),
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(""),
        _line("Content-Length", F.when(revisits, F.lit(0)).otherwise(F.col("size"))),
        F.lit("\r\n"),
    )
    found.select("page_id", header.alias("header"), "address").write.parquet(f"{folder}/records")

    # The payload of each first page; of several with its id and payload any one.
    total = firsts.agg(F.sum("z1")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    heads = firsts.select("address", F.col("head.id").alias("first_id"), F.col("head.like").alias("like"))
    kept = source.select("page_id", "address", "payload").repartition(buckets, "address").join(
        heads.where("like = 1"), "address").where(F.col("page_id").eqNullSafe(F.col("first_id"))).select("address", "payload")
    many = heads.where("like > 1")
    if not many.isEmpty():
        repeated = source.join(many, "address").where(F.col("page_id").eqNullSafe(F.col("first_id"))).groupBy("address").agg(F.any_value("payload").alias("payload"))
        kept = kept.unionByName(repeated).repartition(buckets, "address")
    name = f"warc_payloads_{uuid.uuid4().hex}"
    kept.write.bucketBy(buckets, "address").option("compression", "zstd").option("path", f"{folder}/payloads").saveAsTable(name)
    pages.sparkSession.sql(f"DROP TABLE {name}")  # the files stay
    pages.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{folder}/layout")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads, as a table that Spark knows to lie in buckets."""
    (buckets,) = spark.read.parquet(f"{folder}/layout").first()
    name = f"warc_payloads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (address BINARY, payload BINARY) USING parquet OPTIONS (path '{folder}/payloads') CLUSTERED BY (address) INTO {buckets} BUCKETS")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan has what it needs
    return table


def _record() -> Column:
    """A whole WARC record as bytes: the exact header, the payload of responses, and the closing line ends."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return F.concat(F.col("header").cast("binary"), body, F.lit(_ENDS).cast("binary"))


def record_bytes(records: DataFrame) -> DataFrame:
    """Whole WARC records, from rows with a header, a type and a payload."""
    return records.select("page_id", _record().alias("record"))


def read_archive(spark: SparkSession, folder: str, *, with_payload: bool = True) -> DataFrame:
    """All records: the fields of their headers, the facts of their payloads, and with ``with_payload`` the payloads themselves.

    Every response is put together from its header and its payload, and its facts are taken from the record
    that this makes; it fails if they are not what header and address say.  Revisits have those of their response.
    """
    records = spark.read.parquet(f"{folder}/records").withColumn("record_type", _field("WARC-Type"))
    payloads = _payloads(spark, folder)
    responses = records.where("record_type = 'response'").join(payloads, "address").withColumn("record", _record())
    start = F.octet_length("header")
    held = responses.withColumn("held", F.substring(F.col("record"), start + 1, F.octet_length("record") - start - len(_ENDS)))
    digest = base32(F.sha1("held"))
    right = (
        (F.unhex(F.sha2("held", 256)) == F.col("address")) & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest))
        & (_field("Content-Length").cast("long") == F.octet_length("held"))
    )
    checked = F.when(right, digest).otherwise(F.raise_error(F.concat(F.lit("a record and its payload differ: "), F.col("header"))))
    facts = held.select("page_id", "header", "address", "record_type", F.octet_length("held").cast("long").alias("payload_bytes"), checked.alias("payload_digest"))
    facts = staged(facts, "warc-responses")
    # What revisits refer to: a few addresses may have a great part of all records.
    revisits = records.where("record_type = 'revisit'")
    counts = revisits.groupBy("address").agg(F.count("*").alias("__n"))
    known = facts.groupBy("address").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = lookup(revisits, known.join(counts, "address"), "address", "__n")
    same = _field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    again = again.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a revisit and its payload differ: "), F.col("header")))))
    whole = facts.unionByName(again.select(*facts.columns))
    if with_payload:  # Spark splits an address that many records share
        whole = whole.join(payloads, "address")
    id_type = spark.read.parquet(f"{folder}/records").schema["page_id"].dataType
    return whole.select(
        "page_id", "header", _field("WARC-Target-URI").alias("url"), "payload_bytes", "payload_digest", "record_type",
        F.url_decode(_field("Page-Refers-To")).cast(id_type).alias("refers_to"), *(["payload"] if with_payload else []),
    )
