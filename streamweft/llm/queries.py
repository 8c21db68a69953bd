"""The registered queries of the training-data operators, with production parameters.

Every query reads its whole table.  ``oracle_sql`` has DuckDB SQL where SQL can
express the operator; the others are tested against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup
from .media import media_round_trip
from .mixing import mixing_rates
from .packing import pack_documents
from .quality import classify_quality
from .simhash import near_duplicates
from .substring_dedup import substring_dedup_digests
from .token_counts import length_histogram
from .token_files import token_file_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_documents(spark, sf_dir))


def op4_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_groups(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(_documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dropped_lines(_documents(spark, sf_dir))
    return rows.withColumn("dropped", F.array_join("dropped", ","))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digests(_documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_simhash_near_dedup, op3_token_counts, op4_mixing_to_targets, op5_exact_dedup, op6_token_files, op7_quality_classifier, op8_line_dedup, op9_substring_dedup, op10_media_columns)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.SQL, "op8_line_dedup": line_dedup.SQL}
