"""Tables in the folder that driver and executors share: fresh ones that cut lineage, and ones that are written once."""

from __future__ import annotations

import json
import tempfile
import uuid
from contextlib import contextmanager

from pyarrow.fs import FileSystem, FileType
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in a local session without it (tests) a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def keep(df: DataFrame, name: str, read_as: StructType | None = None) -> DataFrame:
    """Write ``df`` to a fresh table and read it back: what several later jobs use is computed once and outlives executors.

    ``read_as`` is another schema to read it with, such as one with vectors for what they are made of.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(read_as or df.schema).parquet(path)


#: Spark's setting by which an action deletes its shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Actions in here delete their shuffle files as they end; else these stay until the driver happens to collect garbage, which many short steps don't make it do."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete(path: str) -> None:
    """Delete a folder that nothing reads any more; one that isn't there is none."""
    files, at = FileSystem.from_uri(path if not path.startswith("file:") else "/" + path.removeprefix("file:").lstrip("/"))
    if files.get_file_info(at).type == FileType.Directory:
        files.delete_dir(at)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one if nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class OtherParameters(ValueError):
    """A stored table was made with other parameters than those asked for."""


def write_once(spark: SparkSession, path: str, parameters: dict, make) -> DataFrame:
    """The table at ``path``, made by ``make()`` if it isn't there yet; with other parameters than stored ones it is an error.

    Every writer writes a version of its own and then claims the path by a marker; who
    comes second reads what is there. Should two claim at one moment, the lesser version
    counts from then on. A writer that dies before its claim leaves nothing that a reader sees.
    """
    own = json.dumps(parameters, sort_keys=True)
    marker = f"{path}/claimed"

    def claimed() -> DataFrame | None:
        found = stored(spark, marker, "version string, parameters string").collect()  # one row a writer
        if not found:
            return None
        for row in found:
            if row["parameters"] != own:
                raise OtherParameters(f"{path} was made with {row['parameters']}, not {own}")
        return spark.read.parquet(f"{path}/versions/{min(r['version'] for r in found)}")

    if (there := claimed()) is not None:
        return there
    version = uuid.uuid4().hex
    make().write.parquet(f"{path}/versions/{version}")
    try:
        spark.createDataFrame([(version, own)], "version string, parameters string").coalesce(1).write.mode("errorifexists").parquet(marker)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    there = claimed()
    if there is None:
        raise RuntimeError(f"{path} is claimed but its marker can't be read")
    return there


DONE = "batch string, rows long"


def append_batch(rows: DataFrame, path: str, batch: str) -> bool:
    """Store ``rows`` as the batch ``batch``, whole and once; False if it is there already, which adds nothing.

    A batch is a folder of its own, and counts once its line stands in the list of done
    ones, which is written after it. What a lost writer left half done is replaced.
    """
    spark = rows.sparkSession
    if batch in done_batches(spark, path):
        return False
    at = f"{path}/data/batch={batch}"
    rows.write.mode("overwrite").parquet(at)
    n = spark.read.schema(rows.schema).parquet(at).count()
    spark.createDataFrame([(batch, n)], DONE).coalesce(1).write.mode("append").parquet(f"{path}/done")
    return True


def done_batches(spark: SparkSession, path: str) -> set[str]:
    """Names of the batches that were stored whole: one short string a batch comes to the driver."""
    return {r["batch"] for r in stored(spark, f"{path}/done", DONE).select("batch").distinct().collect()}


def batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of all batches that were stored whole, with their ``batch``."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = stored(spark, f"{path}/data", StructType([*kind.fields, StructField("batch", StringType())]))
    return rows.join(stored(spark, f"{path}/done", DONE).select("batch").distinct(), "batch", "left_semi")
