"""Seed generation: rakes, random seeds, ensembles and seeds by block."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Triple = tuple[float, float, float]


def rake_dimension(lo: Triple, hi: Triple) -> int:
    """Axes on which the corners differ: 0 a point, 1 a line, 2 a plane, 3 a solid."""
    return sum(a != b for a, b in zip(lo, hi, strict=True))


def regular_seeds(spark: SparkSession, lo: Triple, hi: Triple, counts: Sequence[int]) -> DataFrame:
    """(seed_id, x, y, z) of a regular rake.

    ``counts`` has one number for each axis on which the corners differ, in axis
    order (one more than that is ignored); the first varies fastest.  A line's
    shares are (n + 1) / (N + 1), so its ends are left out; a plane's and a
    solid's are n / (N - 1), and 0 where N is 1.
    """
    dim = rake_dimension(lo, hi)
    counts = list(counts)[:dim]
    total = prod(counts) if dim else 1
    seeds = spark.range(total).withColumnRenamed("id", "seed_id")
    share, below = {}, 1
    for axis in (a for a in range(3) if lo[a] != hi[a]):
        n = counts[len(share)]
        index = F.pmod(F.floor(F.col("seed_id") / F.lit(below)), F.lit(n))
        if dim == 1:
            share[axis] = (index + 1) / F.lit(float(n + 1))
        else:
            share[axis] = index / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
        below *= n
    return seeds.select("seed_id", *((F.lit(float(lo[a])) + (share[a] * F.lit(float(hi[a]) - float(lo[a])) if a in share else F.lit(0.0))).alias(p) for a, p in enumerate("xyz")))


def hash_uniform(run_seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, not on partitions or order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(run_seed), *keys), 11) / F.lit(float(1 << 53))


def random_seeds(spark: SparkSession, lo: Triple, hi: Triple, n: int, run_seed: int = 0) -> DataFrame:
    """``n`` random seeds in the rake's box; on a plane or line the fixed axes stay fixed."""
    seeds = spark.range(n).withColumnRenamed("id", "seed_id")
    return seeds.select("seed_id", *((F.lit(float(a)) + hash_uniform(run_seed, "seed_id", F.lit(k)) * F.lit(float(b) - float(a))).alias(p) for k, (p, a, b) in enumerate(zip("xyz", lo, hi, strict=True))))


def additive_feedback(seed: int = 1) -> "Generator":  # noqa: F821
    """The additive feedback generator that C libraries use by default (degree 31, lag 3), 31-bit values."""
    r = [seed]
    for i in range(1, 31):
        r.append((16807 * r[i - 1]) % 2147483647)
    r += r[:3]
    state = r[:34]
    for i in range(34, 344):
        state.append((state[i - 31] + state[i - 3]) & 0xFFFFFFFF)
    ring = state[-31:]
    at = 0
    while True:
        value = (ring[at] + ring[(at + 28) % 31]) & 0xFFFFFFFF
        ring[at] = value
        at = (at + 1) % 31
        yield value >> 1


def compatible_seeds(spark: SparkSession, lo: Triple, hi: Triple, n: int, seed: int = 1) -> DataFrame:
    """Seeds as a C program draws them from its default generator: three draws a seed, in
    single precision.  The sequence is serial by nature, so ``n`` numbers are made at plan time."""
    import numpy as np

    draw = additive_feedback(seed)
    a = np.array([[next(draw) for _ in range(3)] for _ in range(n)], np.float32).reshape(-1, 3) / np.float32(2147483647)
    lo_, hi_ = np.array(lo, np.float32), np.array(hi, np.float32)
    p = ((np.float32(1) - a) * lo_ + a * hi_).astype(float)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(p)], "seed_id long, x double, y double, z double")


def resample(points: DataFrame, n: int, run_seed: int = 0) -> DataFrame:
    """``n`` seeds drawn from a point set (x, y, z) with replacement: drawn ranks join the
    points' dense ranks, which come from per-partition counts, not from one global sort."""
    spark = points.sparkSession
    placed = points.select("x", "y", "z").withColumn("part", F.spark_partition_id()).withColumn("mono", F.monotonically_increasing_id())
    sizes = placed.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ranked = placed.join(F.broadcast(sizes), "part").withColumn("rank", F.col("before") + F.col("mono").bitwiseAND(F.lit((1 << 33) - 1)))
    total = points.count()
    drawn = spark.range(n).select(F.col("id").alias("seed_id"), F.floor(hash_uniform(run_seed, "id") * total).alias("rank"))
    return drawn.join(ranked, "rank").select("seed_id", "x", "y", "z")


def with_times(seeds: DataFrame, t: float | Column = 0.0) -> DataFrame:
    return seeds.withColumn("t", t if isinstance(t, Column) else F.lit(float(t)))


def ensemble_seeds(seeds: DataFrame, samples: int) -> DataFrame:
    """Each seed ``samples`` times, with ids seed * samples + sample."""
    out = seeds.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return out.withColumn("source_id", F.col("seed_id")).withColumn("seed_id", F.col("seed_id") * samples + F.col("sample"))


def block_seeds(blocks: DataFrame, n: int, run_seed: int = 0, first_time_only: bool = True) -> DataFrame:
    """``n`` random seeds in the real box of every block (gid, real_lo_x.. real_hi_t); with
    ``first_time_only`` only of blocks that begin at t = 0."""
    live = blocks.where("real_lo_t = 0") if first_time_only else blocks
    out = live.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("seed_id", F.col("gid").cast("long") * n + F.col("n"))
    at = [(F.col(f"real_lo_{p}") + hash_uniform(run_seed, "seed_id", F.lit(k)) * (F.col(f"real_hi_{p}") - F.col(f"real_lo_{p}"))).alias(p) for k, p in enumerate("xyz")]
    return out.select("seed_id", *at, F.col("real_lo_t").cast("double").alias("t"), F.col("gid").alias("block"))


def curvilinear_block_seeds(blocks: DataFrame, vertices: DataFrame, dims: tuple[int, int, int], n: int, run_seed: int = 0) -> DataFrame:
    """``block_seeds`` drawn in index space (ci, cj, ck) and placed by the trilinear blend of the
    curvilinear grid's vertices (i, j, k, x, y, z)."""
    from ..field import FlowField
    from .locate import sample

    places = FlowField.of(vertices.select(F.lit(0).alias("t"), "i", "j", "k", F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w")), dims)
    seeds = block_seeds(blocks, n, run_seed).withColumnRenamed("t", "at")
    out = sample(seeds, places, "seed_id")
    return out.select("seed_id", *(F.col(c).alias(p) for c, p in zip("uvw", "xyz", strict=True)), F.col("at").alias("t"), "block", *(F.col(p).alias(f"c{c}") for p, c in zip("xyz", "ijk", strict=True)))


def assign_seeds(seeds: DataFrame, blocks: DataFrame) -> DataFrame:
    """Seeds (with t) with the lowest-numbered block whose real box holds them; -1 for none.
    Places, not ids, meet the blocks, by bins (``blocks.holding``), so ids may repeat."""
    from .blocks import holding
    from .locate import at_places

    names = ["x", "y", "z", "t"]
    boxes = blocks.select("gid", *(f"real_{s}_{p}" for s in ("lo", "hi") for p in names))
    hit = holding(seeds.select(*names).distinct(), boxes).groupBy(*names).agg(F.min("gid").alias("block"))
    return at_places(seeds, names, hit).withColumn("block", F.coalesce("block", F.lit(-1)))
