"""Exact length histogram: one row per encoded length, with suffix sums.

``length_histogram`` answers, for every context limit L, how many documents
reach it, how many tokens they hold, and how many tokens remain when every
document is cut at L.  ``truncated_total`` and ``quantile`` read the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise
from .tokens import encoder, tokenizer_path
from .words import slices


def with_token_counts(df: DataFrame, columns: list[str], text: str = "text", tokenizer: str | None = None, extra: int = 0) -> DataFrame:
    """``columns`` of every row and ``n_tokens``; null or empty text has ``extra`` tokens only.
    A column of ``columns`` that is named n_tokens is replaced."""
    path = tokenizer or tokenizer_path()
    columns = [c for c in columns if c != "n_tokens"]
    kept = df.select(*columns, F.col(text).alias("__text"))
    schema = kept.drop("__text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "__text"):
                n = enc.counts(part.column("__text")) + extra
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(n)], names=[*columns, "n_tokens"])

    return kept.mapInArrow(count, schema)


def length_histogram(df: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Rows (length, n_docs, n_tokens, docs_at_least, tokens_at_least, truncated_total).

    ``truncated_total`` is the sum of min(n, length) over all documents.  Null
    and empty texts count as length 0; repeated rows each count; an empty table
    gives no row.  Each task first counts its own lengths, so a length that a
    third of all documents share costs one row a task.  The suffix sums run over
    distinct lengths in blocks of 4096 lengths, then over the blocks.
    """
    counts = with_token_counts(df, [], text, tokenizer)
    hist = counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    hist = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.shiftright("length", 12))
    hist = materialise(hist, "length-histogram")  # read three times below; the texts are encoded once
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    inner = hist.select(
        "length", "n_docs", "n_tokens", "block",
        F.sum("n_docs").over(own).alias("d"), F.sum("n_tokens").over(own).alias("t"),
    )
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("at"))
    total = F.lit(hist.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    out = inner.join(blocks, "block")
    docs, tokens = F.col("d") + F.col("ad"), F.col("t") + F.col("at")
    return out.select(
        "length", "n_docs", "n_tokens",
        docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (total - tokens + docs * F.col("length")).alias("truncated_total"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens left when every document is cut at ``limit`` (0 for an empty table)."""
    return hist.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of documents doesn't exceed (null for an empty table)."""
    n = hist.agg(F.coalesce(F.max("docs_at_least"), F.lit(0))).first()[0]
    below = F.lit(n) - F.col("docs_at_least") + F.col("n_docs")
    return hist.where(below >= F.lit(math.ceil(n * q))).agg(F.min("length").alias("length"))
