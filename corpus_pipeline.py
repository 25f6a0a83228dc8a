"""The corpus pipeline: from raw documents to a clean, mixed and sharded training set.

Each stage gets the rows that the one before wrote and returns rows with the
columns of documents; the last adds where each row goes.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.llm import decontam, mixing, ngram_join, quality, sharding
from substrata.llm.common import remove, table, work_path
from substrata.session import ship

SHARDS = 16


def _stage(make):
    @functools.wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return make(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, fitted to the labels, doesn't reject. Nulls, empty and long texts, repeats: see quality.score_documents()."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near and exact copies the document with the smallest id. Nulls, repeats and ties: see ngram_join.keep_one()."""
    return ngram_join.keep_one(docs)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go. Null texts stay null; see decontam.decontaminate()."""
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target weights, documents repeated as their source's rate says. Null sources are one source; see mixing.with_copies()."""
    return mixing.mix(docs)


@_stage
def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with region, rack, shard and slot; columns of these names are replaced. Null ids share a shard; see sharding.placed()."""
    return sharding.placed(docs, sharding.Topology.even(SHARDS))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the classifier; tests/llm/test_stages.py compares each stage's rows with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. What the last stage reads stays in the shared folder, as its rows are made when asked for.

    Empty documents: no rows. Columns that documents has beyond its own stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
