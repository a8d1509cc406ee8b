"""Agreement between labels: confusion, accuracy, F1, kappa, McNemar, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from .ordering import running_total


def confusion(rows: DataFrame, truth: str = "h", pred: str = "m") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("h"), F.col(pred).alias("m")).agg(F.count("*").alias("n"))


def by_class(rows: DataFrame, union: bool) -> DataFrame:
    """Support, precision, recall and F1 of each class; classes are those of truth, or with ``union`` of both."""
    cells = confusion(rows)
    sides = cells.select(F.col("h").alias("class"), "n", F.lit(0).alias("side")).union(cells.select("m", "n", F.lit(1)))
    totals = sides.groupBy("class").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("predicted"))
    hits = cells.where("h = m").select(F.col("h").alias("class"), F.col("n").alias("hit"))
    out = totals.join(hits, "class", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    out = out if union else out.where("support > 0")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = out.withColumn("precision", ratio("hit", "predicted")).withColumn("recall", ratio("hit", "support"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def summary(rows: DataFrame) -> DataFrame:
    """One row: pairs, agreement, macro-F1 (both class sets), kappa, Wilson bounds."""
    cells = confusion(rows)
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("h") == F.col("m"), F.col("n")).otherwise(0)).alias("agreed"))
    own = by_class(rows, True).agg(F.avg("f1").alias("macro_f1_union"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_truth"), F.sum(F.col("support") * F.col("predicted")).alias("chance"))
    both = total.join(F.broadcast(own)).withColumn("po", F.col("agreed") / F.col("n")).withColumn("pe", F.col("chance") / (F.col("n") * F.col("n")))
    low, high = S.wilson(F.col("agreed"), F.col("n"))
    return both.select("n", F.col("po").alias("agreement"), "macro_f1_union", "macro_f1_truth", S.kappa(F.col("po"), F.col("pe"), F.lit(None).cast("double")).alias("kappa"), low.alias("low"), high.alias("high"))


def mcnemar(rows: DataFrame, a: str, b: str, truth: str = "h") -> DataFrame:
    right = lambda c: F.col(c) == F.col(truth)
    counts = rows.agg(F.count_if(right(a) & ~right(b)).alias("b"), F.count_if(~right(a) & right(b)).alias("c"))
    return counts.select("b", "c", S.mcnemar(F.col("b"), F.col("c")).alias("p"))


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rank with ties averaged, from counts of distinct values, which are ordered in ranges."""
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_total(counts, "_v", F.col("_n"), "_upto")
    ranks = upto.select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return rows.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, x, "rx"), y, "ry")
    value = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.agg(F.count("*").alias("pairs"), value.alias("rho")).select("pairs", F.when(F.col("pairs") >= 3, F.col("rho")).alias("rho"))


def policy(label: Column, review: Column, which: str) -> Column:
    """Review overrides by policy (``all`` or ``non_neutral``); a failed review keeps the label."""
    use = review.isNotNull() & (F.lit(which == "all") | (label != "neutral"))
    return F.when(use, review).otherwise(label)


def coverage(legacy: DataFrame, new: DataFrame) -> DataFrame:
    """One row: titles of ``legacy`` since the first of ``new``, how many of them ``new`` has, and their share."""
    first = new.agg(F.min("published_at").alias("_first"))
    own = legacy.join(F.broadcast(first), F.col("published_at") >= F.col("_first"))
    both = own.join(new.select("ticker", "title", F.lit(1).alias("_new")), ["ticker", "title"], "left")
    counts = both.agg(F.count("*").alias("legacy"), F.count("_new").alias("paired"))
    return counts.withColumn("coverage", F.try_divide(F.col("paired"), F.col("legacy")))
