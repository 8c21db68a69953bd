"""The corpus pipeline: quality filter, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes every stage as Parquet into the
shared folder and reads it again, so a stage's lineage ends with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweft.llm.line_dedup import line_dedup
from streamweft.llm.mixing import mix_documents
from streamweft.llm.packing import pack_documents
from streamweft.llm.quality import keep_quality
from streamweft.llm.simhash import near_dedup
from streamweft.llm.storage import materialise


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, _labels(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier go, and longer ones that nearly do; so does a document of which nothing but white space is left,
    or that has no text.  n_chars follows the text."""
    kept = line_dedup(docs)
    kept = kept.where(F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as their rate says."""
    return mix_documents(docs, _labels(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifiers' trees and the tokenizer are not expressible in SQL; tests/llm checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
