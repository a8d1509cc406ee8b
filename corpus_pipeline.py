"""Corpus pipeline: toxic documents go, near copies go, repeated passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, packing, queries, simhash, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the lowest severity, by a model fitted on labelled documents of the corpus."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 13 words or more that an earlier one has."""
    return substrings.strip_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048."""
    return packing.pack_documents(docs, queries.VOCABULARY, 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

#: A fitted model and linked components have no statement in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
