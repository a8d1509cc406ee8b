"""As-of join: each row of one side with the last (or next) row of the other by time, and optionally by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import LIMIT, ranged


def as_of(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, direction: str = "backward", strict: bool = False, limit: int = LIMIT) -> DataFrame:
    """All rows of ``left`` with ``found``, the struct of the right row that is the last at or before their time; null where there is none.

    ``forward`` takes the first at or after; ``strict`` leaves equal times out. Of right
    rows with one time, the last by its other columns counts (forward: the first). Keys
    match null with null; a null time on either side finds nothing.

    Both sides are one table that is dealt into ranges of (keys, time) and sorted once;
    each range carries its last right row on, and the ones before a range come from a
    table with one row for each key and range. So a key that holds most rows is split.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    by = by or []
    later = direction == "backward"
    rest = [F.col(c) for c in right.columns]
    # At one time, right rows go first where equal times count.
    right_first = later != strict
    own = left.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col(left_on).alias("_t"), F.lit(1 if right_first else 0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*rest)).schema[0].dataType).alias("found"))
    other = right.where(F.col(right_on).isNotNull()).select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col(right_on).alias("_t"), F.lit(0 if right_first else 1).alias("_side"), F.lit(None).cast(own.schema["_left"].dataType).alias("_left"), F.struct(*rest).alias("found"))
    keys = [f"_by{k}" for k in range(len(by))]
    both = own.unionByName(other)
    table, sizes = ranged(both, [*keys, "_t", "_side", "found", F.xxhash64("_left")], limit)
    order = ["_range", "_t", "_side", "found"]
    nearest = (lambda c, w: F.last(c, ignorenulls=True).over(w)) if later else (lambda c, w: F.first(c, ignorenulls=True).over(w))
    order = [F.asc(c) for c in order]
    ends = Window.unboundedPreceding, Window.currentRow
    if not later:
        ends = Window.currentRow, Window.unboundedFollowing
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*ends)
    carried = table.withColumn("_in", nearest("found", inside))
    heads = table.where("found is not null").groupBy(*keys, "_range").agg((F.max_by if later else F.min_by)("found", F.struct("_t", "found")).alias("_head"))
    grid = table.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).join(heads.select(*(F.col(k).alias(f"h{k}") for k in keys), F.col("_range").alias("_hr"), "_head"), [F.col(k).eqNullSafe(F.col(f"h{k}")) for k in keys] + [F.col("_range") == F.col("_hr")], "left")
    apart = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*((Window.unboundedPreceding, -1) if later else (1, Window.unboundedFollowing)))
    borders = grid.select(*(F.col(k).alias(f"g{k}") for k in keys), F.col("_range").alias("_gr"), nearest("_head", apart).alias("_from"))
    joined = carried.where("_left is not null").join(borders, [F.col(k).eqNullSafe(F.col(f"g{k}")) for k in keys] + [F.col("_range") == F.col("_gr")])
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_in", "_from"))
    return joined.select("_left.*", found.alias("found"))
