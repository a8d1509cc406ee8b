"""A run of the feed in two phases that can stop anywhere and be resumed: fetch all days, then score what has no score.

Each phase writes what is to do as a queue of steps and streams it, a step a
micro-batch. A step's results become visible all at once, so when a quota runs out all
earlier steps are kept, and the next run's work is what the stored tables lack. A day
and its headlines are one step's rows: neither can be there without the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import storage
from ..operators.ordering import numbered
from ..operators.tables import append_batch, batches, delete

FETCHED = "ticker string, utc_day date, whole boolean, title string, url string, source string, published_at timestamp, fetched_at timestamp, origin string, place long"
SCORED = "ticker string, title string, scorer string, p_negative double, p_neutral double, p_positive double"
#: Titles that a scorer is given at a time.
SCORE_BATCH = 20


def headlines(spark: SparkSession, at: str) -> DataFrame:
    """Headlines fetched so far, by the keep-earliest rule; inserts are ordered by time of fetch, day and place in their answer."""
    rows = batches(spark, f"{at}/fetched", FETCHED).withColumn("seq", F.struct("fetched_at", "utc_day", "place"))
    return storage.upsert_earliest(rows)


def fetched_days(spark: SparkSession, at: str) -> DataFrame:
    """``ticker, utc_day`` that were over when they were fetched; others are fetched again."""
    return batches(spark, f"{at}/fetched", FETCHED).where("whole").select("ticker", "utc_day").distinct()


def scores(spark: SparkSession, at: str, scorer: str | None = None) -> DataFrame:
    """Scores so far; of one title the last stored counts no more than the first, as a scored title is not scored again."""
    rows = batches(spark, f"{at}/scores", SCORED).drop("batch").dropDuplicates(["ticker", "title", "scorer"])
    return rows if scorer is None else rows.where(F.col("scorer") == scorer)


def in_steps(rows: DataFrame, at: str, step: str, work: Callable[[DataFrame], DataFrame], into: str) -> None:
    """Stream ``rows`` in steps of equal ``step``; ``work`` of each is stored as one batch of ``into``. An error in one ends the run and keeps those before."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    queue = f"{at}/queue/{run}"
    rows.withColumn("_step", F.col(step)).repartition("_step").write.partitionBy("_step").parquet(f"{queue}/todo")
    kind = rows.withColumn("_step", F.col(step)).schema

    def each(batch: DataFrame, epoch: int) -> None:
        append_batch(work(batch.drop("_step")), into, f"{run}-{epoch}")

    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{queue}/todo")
    try:
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{queue}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        delete(queue)  # what is left to do is what the stored tables lack


def fetch(spark: SparkSession, at: str, wanted: DataFrame, client: Callable[[str, date], list[dict]], now: datetime, step_days: int = 200) -> None:
    """First phase: all days of ``wanted(ticker, start, end)`` that aren't done, up to today.

    ``client(stock, day)`` gives articles with title, url, source and published_at. It runs
    in the tasks; a step has about ``step_days`` days.
    """
    today = now.date()
    until = wanted.withColumn("end", F.least("end", F.lit(today))).where("start <= end")
    days = numbered(storage.pending(until, fetched_days(spark, at)), ["ticker", "utc_day"], "_n")
    todo = days.select("ticker", "utc_day", T.stock_id(F.col("ticker")).alias("stock"), F.floor((F.col("_n") - 1) / step_days).alias("_unit"))

    def call(parts):
        for part in parts:
            out = []
            for ticker, day, stock in zip(part["ticker"], part["utc_day"], part["stock"], strict=True):
                found = client(stock, day)
                out.append((ticker, day, None, None, None, None, -1))  # the day itself
                out += [(ticker, day, a["title"], a.get("url"), a.get("source"), a["published_at"], k) for k, a in enumerate(found)]
            yield pd.DataFrame(out, columns=["ticker", "utc_day", "title", "url", "source", "published_at", "place"])

    def work(batch: DataFrame) -> DataFrame:
        got = batch.select("ticker", "utc_day", "stock").mapInPandas(call, "ticker string, utc_day date, title string, url string, source string, published_at timestamp, place long")
        at_ = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        return got.select("ticker", "utc_day", (F.col("utc_day") < F.lit(today)).alias("whole"), "title", "url", "source", "published_at", at_.alias("fetched_at"), S.origin(F.col("utc_day"), at_).alias("origin"), "place")

    in_steps(todo, at, "_unit", work, f"{at}/fetched")


def to_score(spark: SparkSession, at: str, scorer: str, since: datetime | None = None) -> DataFrame:
    """Headlines without a score of ``scorer`` since ``since``; price reports are none."""
    bound = None if since is None else F.lit(since.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return storage.unscored(headlines(spark, at), scores(spark, at, scorer), bound).where(~T.is_price_report(F.col("title")))


def score(spark: SparkSession, at: str, scorer: str, judge: Callable[[str, list[str]], list], names: dict[str, str], since: datetime | None = None, size: int = SCORE_BATCH, step_batches: int = 50) -> None:
    """Second phase: titles in batches of ``size`` of one ticker; ``judge(target, titles)`` gives three probabilities or None for each.

    A title without an answer is not stored, so the next run tries it again. ``names`` are
    the companies' names by ticker.
    """
    todo = numbered(to_score(spark, at, scorer, since).select("ticker", "title", "published_at"), ["ticker", "published_at", "title"], "_n")
    todo = todo.select("ticker", "title", F.floor((F.col("_n") - 1) / size).alias("_batch"), F.floor((F.col("_n") - 1) / (size * step_batches)).alias("_unit"))

    def call(part: pd.DataFrame) -> pd.DataFrame:
        ticker = part["ticker"].iloc[0]
        titles = sorted(part["title"])
        given = judge(f"{names.get(ticker, ticker)}（{ticker.split('.')[0]}）", titles)
        out = [(ticker, t, scorer, *p) for t, p in zip(titles, given, strict=True) if p is not None]
        return pd.DataFrame(out, columns=["ticker", "title", "scorer", "p_negative", "p_neutral", "p_positive"])

    in_steps(todo, at, "_unit", lambda batch: batch.groupBy("ticker", "_batch").applyInPandas(call, SCORED), f"{at}/scores")


def report(spark: SparkSession, at: str, scorer: str, since: datetime | None = None) -> DataFrame:
    """By ticker: headlines stored, scored, still without a score, and price reports left out."""
    h = headlines(spark, at) if since is None else headlines(spark, at).where(F.col("published_at") >= F.lit(since.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
    both = h.join(scores(spark, at, scorer).select("ticker", "title", F.lit(1).alias("_s")), ["ticker", "title"], "left")
    price = T.is_price_report(F.col("title"))
    return both.groupBy("ticker").agg(F.count("*").alias("stored"), F.count("_s").alias("scored"), F.count_if(F.col("_s").isNull() & ~price).alias("failed"), F.count_if(F.col("_s").isNull() & price).alias("skipped"))
