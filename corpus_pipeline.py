"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, mixing and sharding.

A stage's result may read tables that the stage has left in the shared folder. They belong to the caller, who may
delete them with common.clear_cuts() once the result has been written; run() does so after each of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import common, decontamination, mixing, nearby, quality, queries, sharding

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go. Other rules for odd rows: quality.good_documents()."""
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id, a null id being the least; of repeated rows one. See nearby.one_of_each()."""
    return nearby.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; null and empty texts stay. See decontamination.clean_documents()."""
    return decontamination.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, in the order of the curriculum; never those without words. See mixing.mixed_documents()."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard, by id; all null ids share one. Every row stays. See sharding.place()."""
    return sharding.place(docs, ["doc_id"], queries.SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Near-duplicate removal by signatures can't be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again. Only the table that the last
    stage reads is left there, until the caller deletes it with common.clear_cuts()."""
    docs, last = queries.table(spark, sf_dir, "documents"), None
    name = uuid.uuid4().hex
    for step, fn in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{step}"
        before = common.cuts(spark)
        fn(spark, docs, sf_dir).write.parquet(path)
        common.clear_cuts(spark, [p for p in common.cuts(spark) if p not in before or p == last])
        common.own(spark, path)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
