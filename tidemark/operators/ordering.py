"""Places and running totals over a whole table in the order of keys, without sorting it in one task.

Rows are dealt into ranges by their whole keys, sorted in each, and written once with
their place in their range. How many a range holds is then known exactly; while one
holds more than ``limit``, all are dealt again into more ranges. What lies before each
range is a table with one row a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep

#: Rows of a range, and how often ranges are dealt anew while one holds more.
LIMIT, ROUNDS = 2_000_000, 3


def ranged(rows: DataFrame, keys: list[str | Column], limit: int = LIMIT) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` with ``_range`` and ``_at``, their place from 0 in it, and each range's number of rows.

    Rows whose keys are all equal share a range, whatever the limit; they get places one after another.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    names = [f"_sort{n}" for n in range(len(keys))]
    keyed = rows.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    parts, sizes = None, {}
    for _ in range(ROUNDS):
        dealt = keyed.repartitionByRange(*names) if parts is None else keyed.repartitionByRange(parts, *names)
        # The high bits of this number are the partition, the low 33 the place in it.
        at = dealt.sortWithinPartitions(*names).withColumn("_at", F.monotonically_increasing_id())
        at = at.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(2**33 - 1))
        table = keep(at.drop(*names), "ranged")
        sizes = {r["_range"]: r["n"] for r in table.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row a range
        if max(sizes.values(), default=0) <= limit:
            break
        parts = max(2 * len(sizes), 2 * -(-sum(sizes.values()) // limit))
    return table, sizes


def _before(table: DataFrame, sums: dict[int, float]) -> DataFrame:
    upto, rows = 0, []
    for k in sorted(sums):
        rows.append((k, upto))
        upto += sums[k]
    kind = "double" if any(isinstance(b, float) for _, b in rows) else "long"
    return table.sparkSession.createDataFrame(rows, f"_range long, _before {kind}")


def numbered(rows: DataFrame, keys: list[str | Column], name: str, limit: int = LIMIT) -> DataFrame:
    """Add each row's place, from 1, in the order of ``keys``; rows with equal keys get different ones."""
    table, sizes = ranged(rows, keys, limit)
    return table.join(F.broadcast(_before(table, sizes)), "_range").select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias(name))


def running_total(rows: DataFrame, key: str, weight: Column, name: str, limit: int = LIMIT) -> DataFrame:
    """Add the sum of ``weight`` over all rows up to the own in the order of ``key``; of rows with one key, each counts those placed before it."""
    table, _ = ranged(rows.withColumn("_weight", weight), [key], limit)
    sums = {r["_range"]: r["s"] for r in table.groupBy("_range").agg(F.sum("_weight").alias("s")).collect()}  # one row a range
    own = F.sum("_weight").over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table.withColumn("_own", own).join(F.broadcast(_before(table, sums)), "_range").select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def percentiles(rows: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """One row with ``n`` and ``p``, the exact percentiles by linear interpolation, from running counts of the distinct values.

    Nulls don't count. Sums of ranges tell which ones hold the places asked for, and only those are looked into.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    table, _ = ranged(counts, ["x"], LIMIT)
    sums = {r["_range"]: r["s"] for r in table.groupBy("_range").agg(F.sum("c").alias("s")).collect()}  # one row a range
    n, before, upto = sum(sums.values()), {}, 0
    for k in sorted(sums):
        before[k] = upto
        upto += sums[k]
    at = [s * (n - 1) for s in shares]
    places = sorted({f(a) for a in at for f in (math.floor, math.ceil)}) if n else []
    some = [k for k in before if any(before[k] <= a < before[k] + sums[k] for a in places)]
    base = F.coalesce(*(F.when(F.col("_range") == k, before[k]) for k in some)) if some else F.lit(0)
    own = F.sum("c").over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + base
    looked = table.where(F.col("_range").isin(some)).withColumn("_upto", own)
    value = {a: F.min(F.when(F.col("_upto") > a, F.col("x"))) for a in places}
    each = [value[math.floor(a)] + (a - math.floor(a)) * (value[math.ceil(a)] - value[math.floor(a)]) for a in at] if n else [F.lit(None).cast("double")] * len(shares)
    return looked.agg(F.lit(n or None).cast("long").alias("n"), F.array(*each).alias("p"))
