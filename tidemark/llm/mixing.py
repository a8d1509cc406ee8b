"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of all words. Sources in the order of
``cap / weight`` meet the rising water level first, so one running sum over one row a
source tells which are clamped at ``epochs`` times their size, and the level that the
rest reach: no rounds of clamping and resharing are run. A source's words are then
taken as whole repetitions of all its documents and a fraction of one more: documents
in seeded hash order up to the words that are wanting, the last one in part. A source
thus takes its target to the word, and no document is taken more than ``epochs`` times.

The hash order is not sorted as a whole. Hashes are dealt into parts of about
``part_rows`` rows; sums of parts say in which one the last document lies, and only
that part is ordered. All of it is DataFrame functions.

A null text has no words, a null source is a source of its own (after all others), and
rows that share an id are ordered by size. Sources without words have the target 0. An
empty table gives an empty result. Other columns of the documents don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words are runs of what is no white space.
WORD, SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Words of a text; every word becomes one letter, in time that grows with the text."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WORD}++{SPACE}*+", "x")
    return F.length(F.regexp_replace(marks, f"^{SPACE}++", "")).cast("long")


def cycled(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``weight``: the weights in turn, over the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place % len(weights)).cast("long"))


def water_filled(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """Add ``target`` to ``sources(source, size, weight)``: shares of all words by weight, none above ``epochs`` sizes."""
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("size") * epochs
    rows = sources.withColumn("_ratio", cap / F.col("weight"))
    left = F.sum("size").over(every) - (F.sum(cap).over(upto) - cap)
    rows = rows.withColumn("_level", left.cast("double") / F.sum("weight").over(onward))
    rows = rows.withColumn("_clamped", F.col("_ratio") < F.col("_level"))
    reached = F.max(F.when(~F.col("_clamped"), F.col("_level"))).over(every)  # levels fall once nothing is clamped
    target = F.when(F.col("_clamped"), cap.cast("double")).otherwise(reached * F.col("weight"))
    return rows.withColumn("target", target).drop("_ratio", "_level", "_clamped")


def mix(docs: DataFrame, weigh=cycled, epochs: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",), part_rows: int = 10_000) -> DataFrame:
    """Columns ``keep`` of every document, ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of it.

    ``weigh`` adds a positive whole ``weight`` to ``sources(source, n, size)``.
    """
    own = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.conv(F.substring(own, 1, 8), 16, 10).cast("long")
    other = [F.col(c) for c in dict.fromkeys(("doc_id", *keep))]
    rows = common.keep(docs.select(*other, F.col("source").alias("_source"), word_count(F.col("text")).alias("size"), place.alias("_place")), "sizes")

    sources = rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    goal = F.floor(F.col("target") + 0.5)
    plan = water_filled(weigh(sources), epochs).select(
        F.col("source").alias("_of"), F.col("size").alias("source_size"), "target",
        goal.alias("_goal"),
        F.ceil(F.col("n") / part_rows).cast("long").alias("_parts"),
    )
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_goal div source_size")).otherwise(0).cast("long"))
    plan = common.keep(plan.withColumn("_extra", F.col("_goal") - F.col("_whole") * F.col("source_size")), "sources")

    def dealt(plan: DataFrame) -> DataFrame:
        part = F.shiftright(F.col("_place") * F.col("_parts"), 32)
        return rows.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_part", part)

    sums = dealt(plan).groupBy("_of", "_part", "_extra").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_of").orderBy("_part")) - F.col("_sum"))
    border = sums.where((F.col("_before") <= F.col("_extra")) & (F.col("_extra") < F.col("_before") + F.col("_sum")))
    border = border.select(F.col("_of").alias("_at"), F.col("_part").alias("_border"), "_before")
    plan = common.keep(plan.join(border, F.col("_of").eqNullSafe(F.col("_at")), "left").drop("_at"), "borders")

    placed = dealt(plan)
    order = Window.partitionBy("_of").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sure = placed.where(~F.coalesce(F.col("_part") == F.col("_border"), F.lit(False)))
    sure = sure.withColumn("_more", F.when(F.col("_part") < F.col("_border"), F.col("size")).otherwise(F.lit(0).cast("long")))
    last = placed.where(F.col("_part") == F.col("_border"))
    room = F.col("_extra") - F.col("_before") - (F.sum("size").over(order) - F.col("size"))
    last = last.withColumn("_more", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), room)))
    taken = F.col("size") * F.col("_whole") + F.col("_more")
    return sure.unionByName(last).select(*keep, "size", "source_size", "target", taken.alias("taken"))


def copies(docs: DataFrame, weigh=cycled, epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mixed corpus: ``doc_id, source, copy, text``, one row for each time that a document is taken; a part is its first words."""
    mixed = mix(docs, weigh, epochs, seed, keep=("doc_id", "source", "text")).where("taken > 0")
    whole = F.expr("taken div size")
    times = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"{WORD}++"), F.lit(0)), F.lit(1), (F.col("taken") % F.col("size")).cast("int")), " ")
    return times.select("doc_id", "source", "copy", F.when(F.col("copy") <= whole, F.col("text")).otherwise(part).alias("text"))
