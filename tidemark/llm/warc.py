"""WARC archives that store a payload once.

Records are built, written, read and joined with DataFrame functions. Each archive
file is a gzipped run of WARC/1.1 records; the archive's own id is part of every
record's first lines and serves as the reader's separator, so payloads that contain
WARC syntax don't break records apart. Reading back splits an archive into exact
record headers and payloads keyed by digest; original records come from their join.

Null HTML is an empty payload; a null URL leaves out its header; line breaks in URLs
are percent-encoded. Records with equal payloads and a null id among other ids revisit
them; if all ids are null, or payloads are small, all are responses. Repeated rows
give repeated records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n"
#: Fixed value of the WARC standard.
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_records(pages: DataFrame, least: int) -> DataFrame:
    """Payload, digests and the page that each record refers to: the largest id among equal payloads of ``least`` bytes or more."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.sha2("payload", 256).alias("strong")
    )
    shared = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("strong").alias("_strong"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("_n"))
        .where("_n > 1 and response_id is not null")
        .drop("_n")
    )
    own = (F.col("strong") == F.col("_strong")) & (F.col("payload_bytes") == F.col("_bytes"))
    rows = rows.join(shared, own, "left").drop("_strong", "_bytes")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("response_id")))


def _line(name: str, *value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), *(F.lit(v) if isinstance(v, str) else v for v in value), F.lit(END))


def separator(archive_id: str) -> str:
    return f"WARC/1.1{END}WARC-Warcinfo-ID: <urn:uuid:{archive_id}>{END}"


def write(pages: DataFrame, path: str, archive_id: str, least: int = 1000, file_records: int = 20_000) -> None:
    """Write one record for each page as gzipped WARC files of ``file_records`` records at most."""
    rows = with_records(pages, least)
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(separator(archive_id)),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", "<urn:tidemark:page:", page("page_id"), ">"),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Payload-Digest", "sha1:", F.col("payload_digest")),
        _line("WARC-Payload-Strong-Digest", "sha256:", F.col("strong")),
        F.when(revisit, F.concat(_line("WARC-Profile", IDENTICAL_PAYLOAD), _line("WARC-Refers-To", "<urn:tidemark:page:", page("refers_to"), ">"))).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", block_bytes.cast("string")),
    )
    record = F.concat(head, F.lit(END), http, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")), F.lit(END))
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, f"(?m)^{name}: <?(.*?)>?\r?$", 1), F.lit(""))


def read(spark: SparkSession, path: str, archive_id: str) -> DataFrame:
    """Records of an archive: exact header, fields, and for responses the payload. A payload that fails its digest is an error."""
    raw = spark.read.option("lineSep", separator(archive_id)).text(path).where("value <> ''")
    rest = F.expr("substring(cast(value as binary), octet_length(head) + 5)")
    rows = raw.select("value", F.substring_index("value", END + END, 1).alias("head")).select("head", rest.alias("rest"))
    http = F.expr("octet_length(substring_index(cast(rest as string), '\r\n\r\n', 1)) + 4")
    rows = rows.select("head", "rest", http.cast("int").alias("http_bytes"))
    payload = F.expr("substring(rest, http_bytes + 1, octet_length(rest) - http_bytes - 4)")
    number = lambda name: F.expr(f"try_cast(regexp_extract({name}, 'page:(-?[0-9]+)', 1) as bigint)")
    rows = rows.select(
        F.concat(F.lit(separator(archive_id)), "head", F.lit(END + END)).alias("header"),
        F.expr("substring(rest, 1, http_bytes)").alias("http_header"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers"),
        F.substring_index(_field(F.col("head"), "WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.substring_index(_field(F.col("head"), "WARC-Payload-Strong-Digest"), ":", -1).alias("strong"),
        payload.alias("payload"),
    )
    rows = rows.withColumn("page_id", number("record_id")).withColumn("refers_to", number("refers")).drop("record_id", "refers")
    wrong = (F.col("record_type") == "response") & ((F.sha1("payload") != F.col("payload_digest")) | (F.sha2("payload", 256) != F.col("strong")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("payload fails its digest: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))).otherwise(F.col("payload"))
    return rows.withColumn("payload", F.when(F.col("record_type") == "response", checked))


def split(records: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """Exact record headers, and payloads (or what else is ``carried`` of them) once for each verified digest."""
    carried = carried or ("payload",)
    headers = records.drop(*carried)
    payloads = records.where("record_type = 'response'").groupBy("strong").agg(*(F.first(c).alias(c) for c in carried))
    return headers, payloads


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Original records: header, HTTP header and payload, also of revisits."""
    return headers.join(payloads, "strong")


def archive(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write pages as an archive in the shared folder and read it back: one row for each page.

    Revisits are rebuilt by the join of their headers with the payload table on the
    strong digest in their own header; it carries sizes and digests instead of payloads.
    """
    spark = pages.sparkSession
    archive_id = str(uuid.uuid4())
    path = f"{common.shared_dir(spark)}/warc-{archive_id}"
    write(pages, path, archive_id, least)
    payload = (F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.sha1("payload")).alias("payload_digest"))
    rows = common.stash(read(spark, path, archive_id).select("page_id", "url", "strong", *payload, "record_type", "refers_to"), "records")
    headers, payloads = split(rows, "payload_bytes", "payload_digest")
    revisits = reconstruct(headers.where("record_type = 'revisit'"), payloads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    return rows.where("record_type = 'response'").select(*revisits.columns).union(revisits)
