"""Event study on a price panel: returns, events, cumulative abnormal returns, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def returns(prices: DataFrame) -> DataFrame:
    """Simple and abnormal return (against all tickers' total), with the session's ordinal."""
    own = Window.partitionBy("ticker").orderBy("session")
    rows = prices.withColumn("ret", F.col("close") / F.lag("close").over(own) - 1)
    total = prices.groupBy("session").agg(F.sum("close").alias("total"))
    market = total.select("session", (F.col("total") / F.lag("total").over(Window.orderBy("session")) - 1).alias("market"), F.row_number().over(Window.orderBy("session")).alias("ord"))
    return rows.join(F.broadcast(market), "session").withColumn("abnormal", F.col("ret") - F.col("market"))


def cumulative(rows: DataFrame, sessions: int = 5) -> DataFrame:
    """Abnormal return over this and the next sessions; null unless all are there."""
    ahead = Window.partitionBy("ticker").orderBy("session").rowsBetween(0, sessions - 1)
    return rows.withColumn("car", F.when(F.count("abnormal").over(ahead) == sessions, F.sum("abnormal").over(ahead)))


def candidates(rows: DataFrame, abnormal: float = C.EVENT_ABNORMAL, raw: float = C.EVENT_RAW, first=None, last=None) -> DataFrame:
    """Days of a fall, by both bounds, from ``first`` to ``last`` where these are given."""
    rows = rows if first is None else rows.where(F.col("session") >= F.lit(first).cast("date"))
    rows = rows if last is None else rows.where(F.col("session") <= F.lit(last).cast("date"))
    return rows.where((F.col("abnormal") <= abnormal) & (F.col("ret") <= raw))


def in_order(events: DataFrame) -> DataFrame:
    """Events by session, then ticker."""
    return events.orderBy("session", "ticker")


def greedy(events: DataFrame, gap: int = C.EVENT_GAP) -> DataFrame:
    """Events at least ``gap`` sessions after the last one kept, by ticker; a ticker has at most one event for each session."""
    empty = F.array().cast("array<int>")
    kept = F.aggregate(
        F.array_sort(F.collect_list("ord")), empty, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(F.concat(F.array(F.lit(-(10**6))), acc), -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc)
    )
    return events.groupBy("ticker").agg(kept.alias("kept")).select("ticker", F.explode("kept").alias("ord"))


def timeline(events: DataFrame, rows: DataFrame, first: int = -10, last: int = 0) -> DataFrame:
    """Rows at each offset before the events, by an equi-join on the ordinal."""
    wanted = events.select("ticker", F.col("ord").alias("event_ord"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("offset"))
    return wanted.withColumn("ord", F.col("event_ord") + F.col("offset")).join(rows, ["ticker", "ord"])


def hits(events: DataFrame, levels: DataFrame, before: int = 5) -> DataFrame:
    """First alerted offset of each event and whether an alert came in the sessions before or on its day; null if none of them can be judged."""
    rows = timeline(events, levels, -before, 0)
    hot, known = F.col("level").isin("high", "watch"), F.col("level") != "insufficient"
    early, today = F.col("offset") < 0, F.col("offset") == 0
    judged = lambda when: F.when(F.count_if(known & when) > 0, F.count_if(hot & when) > 0)
    return rows.groupBy("ticker", "event_ord").agg(F.min(F.when(hot, F.col("offset"))).alias("first_offset"), judged(early).alias("early"), judged(today).alias("same_day"))
