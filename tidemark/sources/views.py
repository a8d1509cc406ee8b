"""Reference tables as views over the TPC-H-like tables, and parsers of the feeds' payloads."""

from __future__ import annotations

import io
import itertools
import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_of_row() -> Column:
    """Where a row of a stored table lies: its file by path, then its number there; readers that go through a table in order meet rows by this."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def headlines(spark: SparkSession, sf_dir: str, start: datetime | None = None, end: datetime | None = None, placed: bool = False) -> DataFrame:
    """Events as scored headlines: ticker, title, time, three probabilities, confidence, source. Some titles are price reports.

    ``start`` and ``end`` (UTC, the latter excluded) reach the scan as bounds of the stored time; ``placed`` adds ``place``, where the row lies in the table.
    """
    kind, n = F.col("event_type"), F.col("event_id")
    rows = read(spark, sf_dir, "events")
    stored = dict(rows.dtypes)["ts"]
    for bound, within in ((start, F.col("ts").__ge__), (end, F.col("ts").__lt__)):
        if bound is not None:
            rows = rows.where(within(F.lit(f"{bound:%Y-%m-%d %H:%M:%S}").cast(stored)))
    price = F.when(n % 9 == 4, " 台股收跌").when(n % 9 == 5, F.concat(F.lit(" 重挫１"), (n % 10).cast("string"), F.lit("點"))).otherwise("")
    return rows.select(
        F.col("user_id").cast("string").alias("ticker"),
        F.concat(kind, F.lit("-"), n.cast("string"), price).alias("title"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.when(kind == "error", 1.0).otherwise(0.0).alias("p_negative"),
        F.when(kind.isin("error", "purchase", "signup"), 0.0).otherwise(1.0).alias("p_neutral"),
        F.when(kind.isin("purchase", "signup"), 1.0).otherwise(0.0).alias("p_positive"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        kind.alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_id",
        "value",
        *([place_of_row().alias("place")] if placed else []),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickers, from one column of the stored table."""
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ticker")).distinct()


def calendar(spark: SparkSession, first: str = "2024-01-01", last: str = "2024-01-31") -> DataFrame:
    """Weekdays as trading sessions."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("session"))
    return days.where(F.weekday("session") < 5)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: idx, text, label (0 to 2), group."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    label = (F.col("quality") + F.col("toxic")).cast("int")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("idx"), "text", label.alias("label"), F.col("source").alias("grp"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by nation and month as closing prices."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("ticker"), month.alias("session")).agg(F.round(F.sum("o_totalprice"), 2).alias("close"))


def phrase_lines(raw: DataFrame, content: str = "content") -> DataFrame:
    """``text, label`` of sentence lines (ISO-8859-1 bytes): the last ``@`` parts text and label; an unknown label is an error."""
    return phrase_rows(raw.select(F.explode(F.split(F.decode(F.col(content), "ISO-8859-1"), r"\r?\n")).alias("line")))


def zip_lines(spark: SparkSession, paths: str | list[str], ending: str, encoding: str = "latin-1", chunk: int = 10_000) -> DataFrame:
    """``path, line`` of the first member of each zip file whose name ends with ``ending``; an archive without one is an error.

    Members are unpacked as streams, ``chunk`` lines at a time, so what a task holds is the packed file and that.
    """

    def unpack(parts):
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    name = next((n for n in archive.namelist() if n.endswith(ending)), None)
                    if name is None:
                        raise ValueError(f"{path} has no member that ends with {ending}")
                    with io.TextIOWrapper(archive.open(name), encoding=encoding) as lines:
                        while own := list(itertools.islice(lines, chunk)):
                            yield pd.DataFrame({"path": path, "line": [x.rstrip("\r\n") for x in own]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(unpack, "path string, line string")


def phrase_rows(lines: DataFrame) -> DataFrame:
    """``text, label`` of ``lines(line)``, blank ones left out."""
    lines = lines.where(F.trim("line") != "")
    label = F.lower(F.trim(F.regexp_extract("line", r"^(.*)@([^@]*)$", 2)))
    number = F.array_position(F.array(*map(F.lit, C.LABELS)), label) - 1
    return lines.select(F.trim(F.regexp_extract("line", r"^(.*)@([^@]*)$", 1)).alias("text"), F.when(number >= 0, number).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label))).cast("int").alias("label"))


def entity_rows(raw: DataFrame) -> DataFrame:
    """``entity, title, label`` of titles whose ``Decisions`` is a dict literal; bad rows and unknown labels are skipped."""
    pairs = raw.select(F.col("Title").alias("title"), F.explode(F.from_json("Decisions", "map<string,string>", {"allowSingleQuotes": "true"})).alias("entity", "name"))
    number = (F.array_position(F.array(*map(F.lit, C.LABELS)), F.lower(F.trim("name"))) - 1).cast("int")
    return pairs.select(F.trim("entity").alias("entity"), "title", number.alias("label")).where((F.col("label") >= 0) & (F.col("entity") != ""))


ITEM = "struct<title:string,link:string,publisher:string,providerPublishTime:bigint,content:struct<title:string,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>,provider:struct<displayName:string>,pubDate:string>>"


def feed_items(raw: DataFrame, column: str = "item") -> DataFrame:
    """Articles of JSON items in nested or flat shape; blank titles and non-objects are dropped."""
    item = raw.select(F.from_json(column, ITEM).alias("i")).where("i is not null")
    nested = F.col("i.content").isNotNull()
    rows = item.select(
        F.when(nested, F.col("i.content.title")).otherwise(F.col("i.title")).alias("title"),
        F.when(nested, F.coalesce("i.content.canonicalUrl.url", "i.content.clickThroughUrl.url", F.lit(""))).otherwise(F.coalesce("i.link", F.lit(""))).alias("url"),
        F.when(nested, F.try_to_timestamp("i.content.pubDate")).otherwise(F.timestamp_seconds("i.providerPublishTime")).alias("published_at"),
        F.when(nested, F.coalesce("i.content.provider.displayName", F.lit(""))).otherwise(F.coalesce("i.publisher", F.lit(""))).alias("source"),
    )
    return rows.where(F.trim("title") != "")


def search_results(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Articles of a search response ``{"articles": [...]}``; missing values are empty."""
    kind = "struct<articles:array<struct<title:string,url:string,publishedAt:string,source:struct<name:string>>>>"
    rows = raw.select(F.explode(F.from_json(column, kind)["articles"]).alias("a"))
    return rows.select(*(F.coalesce(c, F.lit("")).alias(n) for c, n in (("a.title", "title"), ("a.url", "url"), ("a.publishedAt", "published_at"), ("a.source.name", "source"))))


def daily_rows(raw: DataFrame) -> DataFrame:
    """A day's rows ``title, date, source, link``: no forum posts, no source suffix, one row for each title (the earliest), by time."""
    rows = raw.where("title is not null and date is not null").where(~T.is_forum_post(F.col("title")))
    rows = rows.select(T.without_source(F.col("title"), F.coalesce("source", F.lit(""))).alias("title"), F.to_timestamp("date", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("link", F.lit("")).alias("url"))
    return rows.groupBy("title").agg(F.min_by(F.struct("published_at", "source", "url"), "published_at").alias("m")).select("title", "m.*").orderBy("published_at")


def labelled_files(spark: SparkSession, paths: list[str], label: str = "human_label") -> DataFrame:
    """Labelled CSVs: legal labels, upper-case tickers, first row of each (ticker, title), batch from the file's name."""
    rows = spark.read.csv(paths, header=True, multiLine=True, escape='"').withColumn("batch", T.batch_name(F.input_file_name()))
    rows = rows.withColumn("ticker", F.upper("ticker")).where(F.col(label).isin(*C.LABELS)).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy("ticker", "title").agg(F.min_by(F.struct(label, "batch"), "_at").alias("m")).select("ticker", "title", "m.*")


def model_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.json(pattern, multiLine=True)


def cached_articles(cache: DataFrame) -> DataFrame:
    """Rows of ``news_cache`` with their articles exploded; a missing ``fetched_at`` is null."""
    kind = "array<struct<title:string,url:string,published_at:string,source:string,fetched_at:string>>"
    return cache.select("ticker", "bucket", "created_at", F.explode(F.from_json("payload", kind)).alias("a")).select("ticker", "bucket", "created_at", "a.*")


def ex_dates(raw: DataFrame, column: str = "payload") -> DataFrame:
    """``ticker, session`` of ex-rights answers ``{"status": 200, "data": [{"date": ...}]}``; another status is an error, as its data are empty."""
    answer = F.from_json(column, "struct<status:int,msg:string,data:array<struct<date:string>>>")
    rows = raw.select("ticker", answer.alias("a"))
    whole = F.when(F.coalesce(F.col("a.status"), F.lit(0)) == 200, F.col("a.data")).otherwise(F.raise_error(F.concat(F.lit("ex-rights of "), "ticker", F.lit(": "), F.coalesce("a.msg", F.lit("no answer")))))
    return rows.select("ticker", F.explode(whole).alias("d")).select("ticker", F.to_date("d.date", "yyyy-MM-dd").alias("session")).distinct()


def trading_dates(raw: DataFrame) -> DataFrame:
    """Distinct sessions of a feed's ``date`` strings, in order; what is no date goes."""
    return raw.select(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date").alias("session")).where("session is not null").distinct().orderBy("session")


def model_labels(cache: DataFrame, model: str) -> DataFrame:
    """Rows of a label cache of one model with a legal label."""
    return cache.where((F.col("model") == model) & F.col("label").isin(*C.LABELS))


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first source, or the second where the first has no rows."""
    return first if first.take(1) else second


def col_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
