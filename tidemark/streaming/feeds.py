"""Streaming forms of the incremental feed (an extension: the batch forms define the results)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage
from ..operators.tables import delete, stored


def hourly_counts(titles: DataFrame, late: str = "48 hours") -> DataFrame:
    """Titles by source and hour; titles later than ``late`` no longer change a window."""
    return titles.withWatermark("published_at", late).groupBy(F.window("published_at", "1 hour"), "source").agg(F.count("*").alias("n"))


def first_seen(titles: DataFrame, late: str = "48 hours") -> DataFrame:
    return titles.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["ticker", "title"])


STATE = "ticker string, title string, a struct<published_at: timestamp, seq: long, url: string, source: string>, b struct<seq: long, fetched_at: timestamp, origin: string>"
MANIFEST = "upto long, version long"


def upsert_into(stream: DataFrame, path: str, checkpoint: str, merge_after: int = 8, buckets: int = 4):
    """Upsert a stream of headlines by the keep-earliest rule; ``upserted`` reads the result. A folder takes one stream.

    Log-structured: a micro-batch is stored as the state of its keys in a folder of its
    own, which a retry replaces. Once ``merge_after`` of them wait, they are merged with
    the last base into a new one, in ``buckets`` files by key, so reading never takes
    more than one base and that many folders, however long the stream has run.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        own = batch.withColumn("seq", F.lit(epoch).cast("long"))
        storage.upsert_state(own).write.mode("overwrite").parquet(f"{path}/log/epoch={epoch}")
        merge(batch.sparkSession, path, epoch, merge_after, buckets)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last(spark: SparkSession, path: str) -> tuple[int, int]:
    """The last epoch that the newest base holds, and its version; -1 before the first."""
    row = stored(spark, f"{path}/manifest", MANIFEST).agg(F.max(F.struct("version", "upto")).alias("m")).first().m
    return (row["upto"], row["version"]) if row else (-1, -1)


def _states(spark: SparkSession, path: str) -> DataFrame:
    upto, version = _last(spark, path)
    try:
        log = spark.read.parquet(f"{path}/log").where(F.col("epoch") > upto).drop("epoch")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log = None  # nothing waits
    base = spark.read.parquet(f"{path}/base/{version}") if version >= 0 else None
    if base is None:
        return spark.createDataFrame([], STATE) if log is None else log
    return base if log is None else base.unionByName(log)


def merge(spark: SparkSession, path: str, epoch: int, merge_after: int, buckets: int) -> None:
    """Merge what waits into a new base if it is enough; the manifest's line makes it count, and only then what it replaces goes.

    The base before the newest stays, for those who are reading it.
    """
    upto, version = _last(spark, path)
    if epoch - upto < merge_after:
        return
    new = version + 1
    storage.merged_state(_states(spark, path)).repartition(buckets, "ticker", "title").write.mode("overwrite").parquet(f"{path}/base/{new}")
    spark.createDataFrame([(epoch, new)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/line={new}")
    for old in range(max(0, upto + 1 - merge_after), upto + 1):
        delete(f"{path}/log/epoch={old}")
    delete(f"{path}/base/{version - 1}")
    delete(f"{path}/manifest/line={version - 1}")


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """Headlines of all micro-batches by the keep-earliest rule."""
    return storage.headlines_of(storage.merged_state(_states(spark, path)))
