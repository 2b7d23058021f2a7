"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import decontamination, lines, mixing, nearby, parsing, quality, sharding, substrings, tokenstore, urls

#: Production shards: 64 of equal weight.
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_lookup_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], SHARDS)


def op3_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.remove_repeated_bytes(table(spark, sf_dir, "documents"), with_bytes=False)


def op4_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op8_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op6_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeated_lines(table(spark, sf_dir, "documents"))


def op7_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby.classes(table(spark, sf_dir, "documents"))


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_robust_quality,
        op2_lookup_table_sharding,
        op3_prefix_free_dedup,
        op4_curriculum_mixing,
        op5_url_filter,
        op6_line_window_dedup,
        op7_probminhash_near_dedup,
        op8_difference_cover_dedup,
        op9_spaced_seed_decontamination,
        op10_wavelet_token_shards,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op3_prefix_free_dedup": parsing.ORACLE_SQL,
    "op4_curriculum_mixing": mixing.ORACLE_SQL,
    "op6_line_window_dedup": lines.ORACLE_SQL,
    "op8_difference_cover_dedup": substrings.ORACLE_SQL,
}
