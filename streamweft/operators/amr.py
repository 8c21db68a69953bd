"""Adaptive-mesh block forests as relational tables (see ``schema.AMR_BLOCKS``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_P = ("x", "y", "z")


def dense_levels(blocks: DataFrame) -> DataFrame:
    """Raw refinement levels renumbered 0, 1, ... in order; the few levels are broadcast."""
    levels = blocks.select("level").distinct().withColumn("dense", (F.dense_rank().over(Window.orderBy("level")) - 1).cast("int"))
    return blocks.join(F.broadcast(levels), "level").withColumn("level", F.col("dense")).drop("dense")


def level_bounds(blocks: DataFrame) -> DataFrame:
    """Per level: the bounding box, block size on each axis and number of blocks."""
    return blocks.groupBy("level").agg(
        *(f(f"{p}{s}").alias(f"{p}{s}") for p in _P for f, s in ((F.min, "min"), (F.max, "max"))),
        *(F.min(F.col(f"{p}max") - F.col(f"{p}min")).alias(f"size_{p}") for p in _P), F.count("*").alias("n_blocks"),
    )


def region(blocks: DataFrame, lo: tuple, hi: tuple, leaf_only: bool = True) -> DataFrame:
    """Blocks that overlap a box, of leaves only or all."""
    out = blocks.where("has_data") if leaf_only else blocks
    for p, a, b in zip(_P, lo, hi, strict=True):
        out = out.where((F.col(f"{p}min") <= float(b)) & (F.col(f"{p}max") >= float(a)))
    return out


def block_size_range(blocks: DataFrame) -> DataFrame:
    """One row: the smallest and the largest block size on each axis."""
    return blocks.agg(*(f(F.col(f"{p}max") - F.col(f"{p}min")).alias(f"{n}_{p}") for p in _P for f, n in ((F.min, "min"), (F.max, "max"))))


def finest_block(points: DataFrame, blocks: DataFrame, key: str = "point_id") -> DataFrame:
    """Points with the (level, idx) of the finest data block that holds them, the lowest idx of
    equal ones; null for none.

    A point's block at each level is arithmetic on the level's block size, so
    the join is an equi-join per level; the few levels are broadcast.
    """
    data = blocks.where("has_data")
    levels = data.groupBy("level").agg(*(F.min(f"{p}min").alias(f"o{p}") for p in _P), *(F.min(F.col(f"{p}max") - F.col(f"{p}min")).alias(f"s{p}") for p in _P))
    cell = lambda p, at: F.floor((at - F.col(f"o{p}")) / F.col(f"s{p}"))
    placed = data.join(F.broadcast(levels), "level").select("level", "idx", *(cell(p, (F.col(f"{p}min") + F.col(f"{p}max")) / 2).alias(f"c{p}") for p in _P), *(f"{p}{s}" for p in _P for s in ("min", "max")))
    # a point on a face belongs to the blocks on both sides
    sides = F.array(*(F.struct(*(F.lit(-(n >> m & 1)).alias(f"d{p}") for m, p in enumerate(_P))) for n in range(8)))
    asked = points.select(F.col(key).alias("__key"), *_P).join(F.broadcast(levels)).withColumn("d", F.explode(sides))
    asked = asked.select("__key", "level", *_P, *((cell(p, F.col(p)) + F.col(f"d.d{p}")).alias(f"c{p}") for p in _P))
    hit = asked.join(placed, ["level", *(f"c{p}" for p in _P)])
    for p in _P:
        hit = hit.where(F.col(p).between(F.col(f"{p}min"), F.col(f"{p}max")))
    best = hit.groupBy("__key").agg(F.min(F.struct((-F.col("level")).alias("n"), "idx")).alias("b")).select("__key", (-F.col("b.n")).alias("level"), F.col("b.idx").alias("idx"))
    return points.join(best, F.col(key) == F.col("__key"), "left").drop("__key")


def time_runs(blocks: DataFrame, interval: int) -> DataFrame:
    """Runs of consecutive steps in which a block (level, idx) has data, cut into segments of at
    most ``interval`` steps: (level, idx, run, segment, tmin, tmax)."""
    w = Window.partitionBy("level", "idx").orderBy("t")
    rows = blocks.where("has_data").select("level", "idx", "t").distinct()
    rows = rows.withColumn("new", F.when(F.lag("t").over(w) == F.col("t") - 1, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    inner = Window.partitionBy("level", "idx", "run").orderBy("t")
    rows = rows.withColumn("segment", F.floor((F.row_number().over(inner) - 1) / interval).cast("int"))
    return rows.groupBy("level", "idx", "run", "segment").agg(F.min("t").alias("tmin"), F.max("t").alias("tmax"))


def merge_children(blocks: DataFrame, counts: tuple[int, int, int]) -> DataFrame:
    """One bottom-up round: eight data children (2 x 2 x 2 on an even corner) that all have the
    finest level become one block of the level above with their data resolution.

    ``blocks``: level, (ci, cj, ck) at their level, resolution; ``counts`` are
    the blocks of the coarsest level.  Returns the same columns; call it once a level.
    """
    top = blocks.agg(F.max("level").alias("top"))
    marked = blocks.join(F.broadcast(top)).withColumns({f"p{c}": F.floor(F.col(f"c{c}") / 2) for c in "ijk"})
    w = Window.partitionBy("level", "pi", "pj", "pk")
    marked = marked.withColumns({"n": F.count("*").over(w), "same": F.min("resolution").over(w) == F.max("resolution").over(w)})
    full = (F.col("level") == F.col("top")) & (F.col("top") > 0) & (F.col("n") == 8) & F.col("same")
    merged = marked.where(full).groupBy("level", "pi", "pj", "pk").agg(F.max("resolution").alias("resolution"))
    merged = merged.select((F.col("level") - 1).alias("level"), *(F.col(f"p{c}").cast("int").alias(f"c{c}") for c in "ijk"), "resolution")
    return marked.where(~full).select("level", *(F.col(f"c{c}").cast("int").alias(f"c{c}") for c in "ijk"), "resolution").unionByName(merged)


def touching(blocks: DataFrame) -> DataFrame:
    """Pairs (level, idx, other_level, other_idx) of data blocks whose boxes touch or overlap.

    Blocks are listed in the bins of the coarsest block size that they meet;
    a pair is kept in the lowest bin that both share."""
    data = blocks.where("has_data")
    size = data.agg(*(F.max(F.col(f"{p}max") - F.col(f"{p}min")).alias(f"s{p}") for p in _P))
    rows = data.join(F.broadcast(size))
    ranges = [F.sequence(F.floor(F.col(f"{p}min") / F.col(f"s{p}")), F.floor(F.col(f"{p}max") / F.col(f"s{p}"))) for p in _P]
    for p, r in zip(_P, ranges, strict=True):
        rows = rows.withColumn(f"b{p}", F.explode(r))
    names = ["level", "idx", *(f"{p}{s}" for p in _P for s in ("min", "max"))]
    left = rows.select(*names, *(f"b{p}" for p in _P))
    right = left.withColumnsRenamed({n: f"other_{n}" for n in names})
    pairs = left.join(right, [f"b{p}" for p in _P]).where((F.col("level") != F.col("other_level")) | (F.col("idx") != F.col("other_idx")))
    for p in _P:
        pairs = pairs.where((F.col(f"{p}min") <= F.col(f"other_{p}max")) & (F.col(f"{p}max") >= F.col(f"other_{p}min")))
    return pairs.select("level", "idx", "other_level", "other_idx").distinct()
