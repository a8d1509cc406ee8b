"""Trading-session alerts: session bucketing, daily scores, baseline, levels, evidence, board."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scores as S
from ..functions import text as T


def intervals(calendar: DataFrame) -> DataFrame:
    """Sessions with the half-open time they take titles from; the first session is only a border."""
    order = Window.orderBy("session")
    rows = calendar.select("session", S.session_open(F.col("session")).alias("end")).withColumn("start", F.lag("end").over(order))
    return rows.where("start is not null")


def by_session(titles: DataFrame, calendar: DataFrame) -> DataFrame:
    """Titles with the session whose open is the first after them.

    Sessions open at one hour of their day, so a title's time less that hour falls on a
    day, and every day between two opens belongs to one session: the calendar becomes one
    row a day, and an equi-join on the day is all. No title meets more than one row.
    """
    order = Window.orderBy("session")
    spans = calendar.select("session", F.lag("session").over(order).alias("_first")).where("_first is not null")
    days = spans.select("session", F.explode(F.sequence("_first", F.date_sub("session", 1))).alias("_day"))
    opened = F.to_date(F.col("published_at") - F.expr(f"INTERVAL {C.OPEN_UTC_HOUR} HOUR"))
    return titles.withColumn("_day", opened).join(days, "_day").drop("_day")


def span_of(calendar: DataFrame, as_of, sessions: int = C.BASELINE_SESSIONS + 1) -> DataFrame:
    """The sessions that a board of ``as_of`` needs: its baseline, itself, and the one before them, whose open is the border."""
    return calendar.where(F.col("session") <= F.lit(as_of).cast("date")).orderBy(F.desc("session")).limit(sessions + 1)


def borders(calendar: DataFrame) -> tuple[datetime, datetime]:
    """Opens of the first and the last session (UTC): titles from the one up to the other count. One row comes to the driver."""
    row = calendar.agg(F.min("session").alias("a"), F.max("session").alias("b")).first()
    if row.a is None:
        raise ValueError("a calendar without sessions")
    return tuple(datetime(d.year, d.month, d.day, C.OPEN_UTC_HOUR) for d in (row.a, row.b))


def headlines_that_count(titles: DataFrame) -> DataFrame:
    """Titles that are no price reports: those drop out when they are read, even if they were scored."""
    return titles.where(~T.is_price_report(F.col("title")))


def daily_scores(titles: DataFrame, calendar: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """``ticker, session, score, n`` for every ticker and session; without titles the score is null and n zero.

    ``tickers`` is the universe; without it, all tickers with a title, price reports included.
    """
    found = by_session(headlines_that_count(titles), calendar).groupBy("ticker", "session").agg(F.avg(F.col("p_positive") - F.col("p_negative")).alias("score"), F.count("*").alias("n"))
    every = (titles if tickers is None else tickers).select("ticker").distinct()
    grid = every.join(F.broadcast(intervals(calendar).select("session")))
    return grid.join(found, ["ticker", "session"], "left").select("ticker", "session", "score", F.coalesce("n", F.lit(0)).alias("n"))


def assess(daily: DataFrame) -> DataFrame:
    """Baseline, z-score, level, recent trend for every row."""
    order = Window.partitionBy("ticker").orderBy("session")
    before, recent = order.rowsBetween(-C.BASELINE_SESSIONS, -1), order.rowsBetween(1 - C.WINDOW_SESSIONS, 0)
    rows = daily.select(
        "*",
        F.avg("score").over(before).alias("mean"),
        F.stddev_samp("score").over(before).alias("std"),
        F.count("score").over(before).alias("days"),
        F.try_divide(F.sum(F.col("score") * F.col("n")).over(recent), F.sum("n").over(recent)).alias("recent_score"),
        F.collect_list(F.struct("session", "score", "n")).over(recent).alias("recent"),
    )
    enough = (F.col("n") >= C.MIN_ARTICLES) & (F.col("days") >= max(C.MIN_BASELINE_DAYS, 2))
    z = F.when(enough, (F.col("score") - F.col("mean")) / F.greatest("std", F.lit(C.SIGMA_FLOOR)))
    return rows.withColumn("z", z).withColumn("level", S.level(F.col("n"), F.col("z"))).withColumn("change", F.col("score") - F.col("mean"))


def missing_days(tickers: DataFrame, fetched: DataFrame, first, last) -> DataFrame:
    """Calendar days of the span that were not fetched, by ticker."""
    days = tickers.select("ticker", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("utc_day"))
    gaps = days.join(fetched.select("ticker", "utc_day"), ["ticker", "utc_day"], "left_anti")
    return tickers.join(gaps.groupBy("ticker").agg(F.count("*").alias("missing")), "ticker", "left").select("ticker", F.coalesce("missing", F.lit(0)).alias("missing"))


def with_coverage(assessed: DataFrame, missing: DataFrame) -> DataFrame:
    """A ticker with unfetched days is insufficient and has no z."""
    rows = assessed.join(missing, "ticker", "left")
    gap = F.coalesce("missing", F.lit(0)) > 0
    return rows.withColumn("level", F.when(gap, "insufficient").otherwise(F.col("level"))).withColumn("z", F.when(~gap, F.col("z"))).drop("missing")


def evidence(titles: DataFrame, calendar: DataFrame, n: int = 3) -> DataFrame:
    """The most negative titles of each ticker and session, price reports left out."""
    rows = by_session(headlines_that_count(titles), calendar).withColumn("score", F.col("p_positive") - F.col("p_negative")).where("score < 0")
    order = Window.partitionBy("ticker", "session").orderBy("score", "published_at", "title")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def with_evidence(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with ``evidence``, the ranked structs of their ticker and session; empty where there are none."""
    item = F.struct("rank", "title", "source", "published_at", "score")
    nested = found.groupBy("ticker", "session").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    kind = nested.schema["evidence"].dataType.simpleString()
    return rows.join(nested, ["ticker", "session"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(kind)))


def board(assessed: DataFrame, as_of: str, include_all: bool = True) -> DataFrame:
    rows = assessed.where(F.col("session") == F.lit(as_of).cast("date"))
    rows = rows if include_all else rows.where(F.col("level").isin("high", "watch"))
    return rows.orderBy(S.level_rank(F.col("level")), F.coalesce("z", F.lit(0.0)), "ticker")


def parameters() -> Column:
    """The board's parameters as a map from name to number."""
    own = {"window_sessions": C.WINDOW_SESSIONS, "baseline_sessions": C.BASELINE_SESSIONS, "watch_z": C.WATCH_Z, "high_z": C.HIGH_Z, "min_articles": C.MIN_ARTICLES, "min_baseline_days": C.MIN_BASELINE_DAYS, "sigma_floor": C.SIGMA_FLOOR}
    return F.create_map(*(F.lit(x) for name, value in own.items() for x in (name, float(value))))


def extend(calendar: DataFrame, now) -> DataFrame:
    """Calendar with the weekdays after it up to the first that opens later than ``now``."""
    last = calendar.agg(F.max("session").alias("last"))
    days = last.select(F.explode(F.sequence(F.date_add("last", 1), F.greatest(F.date_add("last", 1), F.date_add(F.to_date(F.lit(now)), 4)))).alias("session"), "last")
    days = days.where((F.weekday("session") < 5) & (S.session_open(F.col("last")) <= F.lit(now)))
    first = days.where(S.session_open(F.col("session")) > F.lit(now)).agg(F.min("session").alias("until"))
    return calendar.unionByName(days.join(F.broadcast(first), F.col("session") <= F.col("until")).select("session"))
