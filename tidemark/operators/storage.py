"""Keyed storage: upserts, backlogs, caches, export gates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def upsert_state(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """What the keep-earliest rule needs to know of each (ticker, title): the earliest row ``a`` and the first insert ``b``.

    States of parts of the inserts merge by ``merged_state``, in any order and any grouping.
    """
    rows = rows.where("title is not null and published_at is not null")
    a, b = F.struct("published_at", F.col(seq).alias("seq"), "url", "source"), F.struct(F.col(seq).alias("seq"), "fetched_at", "origin")
    return merged_state(rows.select("ticker", "title", a.alias("a"), b.alias("b")))


def merged_state(states: DataFrame) -> DataFrame:
    return states.groupBy("ticker", "title").agg(F.min("a").alias("a"), F.min("b").alias("b"))


def headlines_of(state: DataFrame) -> DataFrame:
    return state.select("ticker", "title", "a.published_at", "a.url", "a.source", "b.fetched_at", "b.origin")


def upsert_earliest(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Headlines by (ticker, title): earliest time; url and source of the row that has it (first insert wins ties); fetched_at and origin of the first insert."""
    return headlines_of(upsert_state(rows, seq))


def last_write(rows: DataFrame, keys: list[str], seq: str = "seq", place: str | None = None) -> DataFrame:
    """The row of each key with the largest ``seq``, whole; of several such, the first by ``place`` (anything with an order), which is not returned. Rows without a ``seq`` don't count."""
    rest = [c for c in rows.columns if c not in (*keys, seq, place)]
    own = F.struct(*rest)
    last = F.max_by(own, F.col(seq)) if place is None else F.min_by(own, F.when(F.col(seq).isNotNull(), F.struct(-F.col(seq), F.col(place))))
    return rows.groupBy(*keys).agg(last.alias("_v")).select(*keys, *(f"_v.{c}" for c in rest))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def replace_by(old: DataFrame, new: DataFrame, key: str, value) -> DataFrame:
    """``old`` without the rows whose key is ``value``, and ``new``; rows with another key stay, a null one too."""
    return old.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(new)


def unscored(headlines: DataFrame, scores: DataFrame, since=None) -> DataFrame:
    """Headlines without a score; a left anti join whose lower bound reaches the scan."""
    rows = headlines if since is None else headlines.where(F.col("published_at") >= since)
    return rows.join(scores.select("ticker", "title"), ["ticker", "title"], "left_anti")


def scored_window(headlines: DataFrame, scores: DataFrame, start, end) -> DataFrame:
    rows = headlines.where((F.col("published_at") >= start) & (F.col("published_at") < end))
    return rows.join(scores, ["ticker", "title"])


def pending(ranges: DataFrame, done: DataFrame) -> DataFrame:
    """(ticker, utc_day) of all ranges (ticker, start, end) that are not done."""
    days = ranges.select("ticker", F.explode(F.sequence("start", "end")).alias("utc_day")).distinct()
    return days.join(done, ["ticker", "utc_day"], "left_anti")


def latest_bucket(cache: DataFrame) -> DataFrame:
    return cache.groupBy("ticker").agg(F.max("bucket").alias("bucket"), F.max_by("payload", "bucket").alias("payload"))


def read_through(cache: DataFrame, bucket: int, failed: bool) -> DataFrame:
    """Cached payload of ``bucket``, or when fetching failed the latest one flagged stale."""
    if not failed:
        return cache.where(F.col("bucket") == bucket).select("ticker", "bucket", "payload", F.lit(False).alias("stale"))
    return latest_bucket(cache).withColumn("stale", F.col("bucket") != bucket)


def check_export(ok: int, tickers: int, mock: bool, latest: str | None, before: str | None) -> None:
    """Gates before publishing: no mock model, enough coverage, no step back in time."""
    check_coverage(ok / (2 * tickers) if tickers else 1.0, mock, latest, before)


def check_coverage(coverage: float, mock: bool, latest: str | None, before: str | None) -> None:
    """A published date must not be lost either: none now where there was one is a step back."""
    if mock or coverage < C.EXPORT_MIN_COVERAGE or (before and (not latest or latest < before)):
        raise ValueError(f"export refused: mock={mock}, coverage={coverage:.2f}, latest={latest}, before={before}")


def export_boards(boards: DataFrame, path: str, sessions: int = 120) -> None:
    """One folder of JSON for each of the last sessions; of these, boards that are insufficient throughout are left out."""
    use = boards.groupBy("session").agg(F.count_if(F.col("level") != "insufficient").alias("n")).orderBy(F.desc("session")).limit(sessions).where("n > 0")
    boards.join(use.select("session"), "session").repartition("session").write.partitionBy("session").mode("overwrite").json(path)


def export_site(path: str, boards: DataFrame, stocks: dict[str, DataFrame], names: DataFrame, mock: bool, before: str | None = None, sessions: int = 120, **meta) -> dict:
    """Publish boards, each kind of ``stocks(ticker, ...)`` by ticker, the list of ``names(ticker, name)`` and a line of metadata, or refuse by the gates.

    The metadata come last, so a reader that waits for them never sees half a site. Only counts and one date reach the driver.
    """
    spark = boards.sparkSession
    tickers = names.select("ticker").distinct()
    have = [df.select("ticker").distinct().join(tickers, "ticker").count() for df in stocks.values()]
    total, ok = tickers.count(), sum(have)
    use = boards.groupBy("session").agg(F.count_if(F.col("level") != "insufficient").alias("n")).orderBy(F.desc("session")).limit(sessions).where("n > 0")
    newest = use.agg(F.max("session").cast("string").alias("s")).first()["s"]
    coverage = ok / (len(stocks) * total) if total and stocks else 1.0
    check_coverage(coverage, mock, newest, before)
    for kind, df in stocks.items():
        df.join(tickers, "ticker").repartition("ticker").write.partitionBy("ticker").mode("overwrite").json(f"{path}/stocks/{kind}")
    export_boards(boards, f"{path}/alerts", sessions)
    names.coalesce(1).write.mode("overwrite").json(f"{path}/tickers")
    line = {"alerts_latest": newest, "coverage": round(coverage, 4), "tickers": total, **meta}
    spark.createDataFrame([(json.dumps(line),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return line


def blind_copies(sample: DataFrame, path: str, hidden: list[str]) -> None:
    sample.write.mode("overwrite").option("header", True).csv(f"{path}/full")
    sample.drop(*hidden).write.mode("overwrite").option("header", True).csv(f"{path}/blind")


def first_per_key(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def newest_first(rows: DataFrame, column: str = "published_at") -> DataFrame:
    """Rows by time as text, the newest first; what is no time counts as the epoch, ties keep title order."""
    return rows.orderBy(F.coalesce(F.try_to_timestamp(column), F.timestamp_seconds(F.lit(0))).desc(), "title")


def required(rows: DataFrame, what: str) -> DataFrame:
    """``rows``, or an error if there are none."""
    if not rows.take(1):
        raise LookupError(f"no {what}")
    return rows
