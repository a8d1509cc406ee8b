"""Helpers shared by the operators: shared-folder tables, Arrow mapping, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in a local session without it (tests) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settle(spark: SparkSession) -> None:
    """Let go of finished steps, so that Spark's cleaner deletes their shuffle files now and not at some later garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Cuts the lineage with files that outlive executors, so a table used by several
    later jobs is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """``keep``, then let go of the shuffle files that led to the table."""
    kept = keep(df, name)
    settle(df.sparkSession)
    return kept


def discard(df: DataFrame) -> None:
    """Delete a table of ``stash`` that nothing needs any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended where ``df`` has a column so called, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def widened(df: DataFrame, **more: str) -> StructType:
    """The schema of ``df`` with ``more`` columns, all nullable."""
    own = [StructField(f.name, f.dataType) for f in df.schema]
    return StructType(own + [StructField(name, DataType.fromDDL(kind)) for name, kind in more.items()])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for functions that yield a dict of columns for each output batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, wanted = df.columns, [f.name for f in out]
    # Spark resolves the columns by name there, which dots and backticks would break.
    plain = not any(c in name for name in names for c in ".`")
    own = out if plain else StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(out)])
    kind = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batch.rename_columns(names) for batch in batches):
            cells = ((columns[name], f.type) for name, f in zip(wanted, kind, strict=True))
            yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in cells], schema=kind)

    if plain:
        return df.mapInArrow(run, out)
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, own).toDF(*wanted)


def text_rows(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Texts of a batch one by one; null counts as empty."""
    for value in batch.column(batch.schema.names.index(column)):
        yield value.as_py() or ""


_KEPT: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks. Workers serve several operators in turn, so only the last one's memory stays."""
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[name] = make()
    return _KEPT[name]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component being the smallest node.

    Alternates the large-star and small-star steps until nothing changes. Each step
    is an aggregation with map-side combine and a sort-merge join that adaptive
    execution can split, so a node with very many links needs no task of its own.
    Nodes without an edge have no row.
    """
    now = stash(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down.withColumnRenamed("a", "k"), F.col("a") == F.col("k"))
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = stash(small, "edges")
        # Stable once every node has one parent and no parent has a parent.
        roots = after.select(F.col("b").alias("a")).distinct()
        many = after.groupBy("a").count().where("count > 1").select("a")
        done = not roots.join(after, "a", "left_semi").union(many).take(1)
        discard(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())
