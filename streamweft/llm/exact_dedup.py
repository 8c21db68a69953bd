"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]``
is deleted.  Every stage groups by digest *and* full normalised text:

1. each map task combines its own rows (Spark's partial aggregation),
2. groups are merged by (digest, salt, text), the salt being the map task's
   number, so one text's partial results spread over ``salts`` reducers,
3. the salt winners are combined by (digest, text).

The winner table has one small row a text.  Documents find their winner by the
text's SHA-256, an independent 64-bit hash and its length, not by the text
itself: two texts that share all three would be two groups in stage 3, and
their documents would match both.  Texts that hold more than
``1 / HOT`` of all rows, fewer than ``HOT`` by arithmetic, are matched by a
broadcast join; all others by a shuffle in which no key is that frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

SALTS = 16
HOT = 2000

_SPACE = " \t\n\x0b\f\r"
#: Room for a document id in the order key, an id being 64 bits and null last.
_ID_ROOM = "18446744073709551617"
_MAX_ID = "9223372036854775807"


def _order(doc_id: str, text: str) -> Column:
    """One decimal whose maximum is the longest text (code points), then the smallest id, nulls last."""
    room, largest = (F.lit(x).cast("decimal(38,0)") for x in (_ID_ROOM, _MAX_ID))
    length = F.coalesce(F.length(text), F.lit(0)).cast("decimal(10,0)")
    inverse = F.coalesce(largest - F.col(doc_id).cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)")) + F.lit(1)
    return (length * room + inverse).cast("decimal(38,0)")


def _id_of(order: Column) -> Column:
    room, largest = (F.lit(x).cast("decimal(38,0)") for x in (_ID_ROOM, _MAX_ID))
    rest = F.pmod(order, room)
    return F.when(rest > 0, (largest - (rest - F.lit(1))).cast("long"))


def exact_dedup_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group.  Of equal
    texts the row with the most code points stays, then the smallest doc_id; a
    null id loses ties and, if it wins alone, keep_id is null.  Rows repeated
    whole each count and all say ``kept`` when their id is the winner's
    (``exact_dedup`` returns one of them).  Other columns are ignored.  An empty
    table gives no row.
    """
    rows = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.translate(F.coalesce(F.col(text), F.lit("")), _SPACE, "").alias("norm"),
        F.col(text).alias("text"),
    )
    rows = rows.select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"), _order("doc_id", "text").alias("rank"))
    key = ["digest", "content", "size"]
    docs = materialise(rows.select("doc_id", "digest", F.xxhash64("norm").alias("content"), F.length("norm").alias("size")), "exact-digests")

    local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "salt", "norm").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    winners = materialise(
        winners.select("digest", F.xxhash64("norm").alias("content"), F.length("norm").alias("size"), _id_of(F.col("rank")).alias("keep_id"), "group_size"),
        "exact-winners",
    )

    total = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = winners.where(F.col("group_size") * HOT > F.lit(total))  # fewer than HOT rows
    cold = winners.where(F.col("group_size") * HOT <= F.lit(total))
    first = docs.join(F.broadcast(hot), key, "left")
    is_hot = F.col("group_size").isNotNull()
    rest = first.where(~is_hot).drop("keep_id", "group_size").join(cold, key)
    both = first.where(is_hot).select("doc_id", "keep_id", "group_size", "digest").unionByName(rest.select("doc_id", "keep_id", "group_size", "digest"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``df`` that stay, one a text, with all their columns."""
    stay = exact_dedup_groups(df, doc_id, text, salts).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), _SPACE, ""), 256)
    match = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__row_sha") == F.col("__sha"))
    kept = df.withColumn("__row_sha", sha).join(stay, match, "left_semi")
    return kept.dropDuplicates([doc_id, "__row_sha"]).drop("__row_sha")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
