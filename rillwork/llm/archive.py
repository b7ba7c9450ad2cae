"""Content-addressed WARC archive.

Each distinct payload is stored once under its SHA-256; each record's exact header block is a row of its own table, naming that
digest. Records come back through a join of both and are verified: the payload of a rebuilt record must have the digest and the length
that its header says. Equal payloads of at least `least` bytes make revisit records of all but the smallest page identifier's.

Copies of a payload fold in their tasks before they move. Payloads are bucketed by digest, so rebuilding records moves the headers to
them and no payload again. A digest with a large share of the records (payloads too small for revisits) is broadcast, if its payload is
below BROADCAST_BYTES; those are at most HOT_SHARE.

Defined cases: null html is an empty payload; a null url gives an empty target; rows repeating identifier and payload are records of
their own, all of the same kind; a group whose identifiers are all null has responses only; an empty table gives empty archives;
other columns don't matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import HOT_SHARE, attach, stored, text_of

LEAST = 100
#: Payloads up to this size are broadcast where a large share of the records has them; and bytes of payloads that a bucket holds about.
BROADCAST_BYTES, BUCKET_BYTES = 4096, 64 << 20
#: Fixed values of the archive format.
VERSION, LINE = "WARC/1.1", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    return F.concat_ws("", F.lit(VERSION + LINE), *(F.concat(F.lit(f"{n}: "), v, F.lit(LINE)) for n, v in fields), F.lit(LINE))


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2026-01-01T00:00:00Z") -> None:
    """Writes folder/payloads (payload_digest, payload) and folder/records (payload_digest, copies, header)."""
    spark = pages.sparkSession
    own = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.regexp_replace(text_of(url_col), r"[\r\n]", " ").alias("url"),
        text_of(html_col).cast("binary").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    facts = stored(own.drop("payload"), "page-facts")
    groups = facts.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_size"), F.max("payload_bytes").alias("_bytes"))
    size = groups.agg(F.sum("_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    distinct = own.groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    distinct.repartition(buckets, "payload_digest").write.bucketBy(buckets, "payload_digest").option("path", f"{folder}/payloads").saveAsTable(_payloads(folder))
    rows = attach(facts, stored(groups.drop("_bytes"), "page-groups"), "payload_digest", "_size", facts.count())
    again = (F.col("payload_bytes") >= least) & (F.col("page_id") != F.col("first_id"))
    kind = F.when(again, "revisit").otherwise("response")
    identity = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    header = _lines(
        ("WARC-Type", kind),
        ("WARC-Record-ID", identity),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))),
        ("WARC-Profile", F.when(again, REVISIT_PROFILE)),
        ("Content-Type", F.lit("text/html")),
        ("Content-Length", F.when(again, "0").otherwise(F.col("payload_bytes").cast("string"))),
    )
    rows.select("payload_digest", F.col("_size").alias("copies"), header.alias("header")).write.parquet(f"{folder}/records")


def field(header: str, name: str) -> Column:
    value = F.regexp_extract(header, rf"(?:^|\n){name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def _payloads(folder: str) -> str:
    """The name that the session's catalog has for the payloads of the archive at this whole path."""
    return f"payloads_{hashlib.sha256(folder.rstrip('/').encode()).hexdigest()[:40]}"


def _read(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records and payloads; a session that didn't write the archive reads its payloads without their buckets."""
    name = _payloads(folder)
    payloads = spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(f"{folder}/payloads")
    return spark.read.parquet(f"{folder}/records"), payloads


def original_records(spark, folder: str) -> DataFrame:
    """Each record as its archive has it: header, and record: the exact bytes of header block, payload (none for revisits), two line ends.

    A response stops the read if its payload hasn't the digest and length that its header says."""
    records, payloads = _read(spark, folder)
    records = records.select("copies", "header", F.regexp_extract("header", r"WARC-Payload-Digest: sha256:(\w+)", 1).alias("payload_digest"))
    responses = records.filter(field("header", "WARC-Type") == "response")
    most = max(1, records.count() // HOT_SHARE)
    hot = F.col("copies") > most
    few = responses.filter(hot).groupBy("payload_digest").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("payload_digest")
    small = payloads.join(F.broadcast(few), "payload_digest", "left_semi").filter(F.octet_length("payload") <= BROADCAST_BYTES)
    marked = responses.join(F.broadcast(small.withColumnRenamed("payload", "_small")), "payload_digest", "left")
    near = marked.filter(F.col("_small").isNotNull()).select("header", "payload_digest", F.col("_small").alias("payload"))
    far = marked.filter(F.col("_small").isNull()).select("header", "payload_digest")
    met = payloads.join(far.hint("shuffle_hash"), "payload_digest").select("header", "payload_digest", "payload").unionByName(near)
    true = (F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == field("header", "Content-Length").cast("bigint"))
    checked = F.when(true, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_digest"))).cast("binary"))
    revisits = records.filter(field("header", "WARC-Type") == "revisit").select("header", "payload_digest", F.lit("").cast("binary").alias("payload"))
    whole = met.withColumn("payload", checked).unionByName(revisits)
    return whole.select("header", "payload_digest", F.concat(F.col("header").cast("binary"), "payload", F.lit(LINE * 2).cast("binary")).alias("record"))


def read_records(spark, folder: str) -> DataFrame:
    """One row per record, read from the rebuilt records: what its header says, with the digest and length of its payload or, for a
    revisit, of the payload that it leads to."""
    body = F.octet_length(F.col("header").cast("binary"))
    rebuilt = original_records(spark, folder)
    payload = F.substring(F.col("record"), body + 1, F.octet_length("record") - body - len(LINE) * 2)
    page = lambda name: F.regexp_extract(field("header", name), r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    found = stored(
        rebuilt.select(
            page("WARC-Record-ID").alias("page_id"), "payload_digest", F.octet_length(payload).cast("bigint").alias("payload_bytes"), field("header", "WARC-Type").alias("record_type"),
            page("WARC-Refers-To").alias("refers_to"), field("header", "WARC-Target-URI").alias("url"), "header"
        ),
        "read-records",
    )
    revisits = found.filter("record_type = 'revisit'").drop("payload_bytes")
    sizes = found.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    sizes = stored(sizes.join(revisits.groupBy("payload_digest").agg(F.count("*").alias("_size")), "payload_digest"), "revisited")
    again = attach(revisits, sizes, "payload_digest", "_size", found.count(), "inner").drop("_size")
    return found.filter("record_type = 'response'").unionByName(again)
