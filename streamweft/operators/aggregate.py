"""Field extrema, run statistics, flow matrices and spatial trees."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import dot, vec

_V = ("u", "v", "w")


def extrema_per_step(nodes: DataFrame) -> DataFrame:
    """For each t the vectors of least and greatest magnitude; of equal ones the first in node order."""
    m = dot(vec(*_V), vec(*_V))
    place = F.struct("k", "j", "i")
    row = F.struct(*_V, "i", "j", "k")
    parts = nodes.groupBy("t").agg(F.min(F.struct(m.alias("m"), place.alias("at"), row.alias("row"))).alias("lo"), F.min(F.struct((-m).alias("m"), place.alias("at"), row.alias("row"))).alias("hi"))
    return parts.select("t", *(F.col(f"{s}.row.{c}").alias(f"{n}_{c}") for s, n in (("lo", "min"), ("hi", "max")) for c in (*_V, "i", "j", "k")), F.sqrt(F.col("lo.m")).alias("min_mag"), F.sqrt(-F.col("hi.m")).alias("max_mag"))


def extrema_all(nodes: DataFrame) -> DataFrame:
    """One row: the extrema over all steps (the earliest step of equal ones), and their steps."""
    e = extrema_per_step(nodes)
    low = F.min_by(F.struct("t", "min_u", "min_v", "min_w", "min_mag"), F.struct("min_mag", "t")).alias("lo")
    high = F.min_by(F.struct("t", "max_u", "max_v", "max_w", "max_mag"), F.struct((-F.col("max_mag")).alias("m"), "t")).alias("hi")
    out = e.agg(low, high)
    return out.select(F.col("lo.t").alias("min_t"), "lo.min_u", "lo.min_v", "lo.min_w", "lo.min_mag", F.col("hi.t").alias("max_t"), "hi.max_u", "hi.max_v", "hi.max_w", "hi.max_mag")


def bounding_box(vertices: DataFrame, *by: str) -> DataFrame:
    return vertices.groupBy(*by).agg(*(f(p).alias(f"{p}{n}") for p in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def run_statistics(df: DataFrame, key: str, *metrics: str, integer_means: bool = False) -> DataFrame:
    """One row a metric: total, min, argmin, max, argmax, mean, population variance and deviation
    over ``key``; the smallest key of equal ones.  ``integer_means`` truncates the mean and takes
    the variance about it, as count reports do."""
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m"))
    long = long.select("key", "m.metric", "m.value")
    out = long.groupBy("metric").agg(
        F.sum("value").alias("total"), F.min("value").alias("min"), F.min(F.struct("value", "key")).alias("lo"),
        F.max("value").alias("max"), F.min(F.struct((-F.col("value")).alias("v"), "key")).alias("hi"),
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance"),
    )
    out = out.select("metric", "total", "min", F.col("lo.key").alias("argmin"), "max", F.col("hi.key").alias("argmax"), "mean", "variance")
    if integer_means:
        cut = F.floor("mean").cast("double")
        out = out.withColumn("variance", F.col("variance") + (F.col("mean") - cut) * (F.col("mean") - cut)).withColumn("mean", cut)
    return out.withColumn("std", F.sqrt("variance"))


def block_weights(particles: DataFrame, block: str = "block", steps: str = "steps") -> DataFrame:
    return particles.groupBy(block).agg(F.sum(steps).alias("weight"))


def flow_matrix(moves: DataFrame, origin: str = "from_block", target: str = "to_block") -> DataFrame:
    return moves.groupBy(origin, target).agg(F.count("*").alias("n"))


def trace_counts(points: DataFrame) -> DataFrame:
    """Points of every trace."""
    return points.groupBy("seed_id", "dir").agg(F.count("*").alias("n_points"))


def trace_summary(points: DataFrame) -> DataFrame:
    """One row: number of traces, of points, and points of the longest trace."""
    return trace_counts(points).agg(F.count("*").alias("n_traces"), F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"), F.coalesce(F.max("n_points"), F.lit(0)).alias("longest"))


def merge_blocks(df: DataFrame, key: str, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, radix: int = 8) -> DataFrame:
    """Merge the blocks numbered ``key`` to one by rounds of groups of ``radix``; ``merge`` gets
    a group's rows and returns rows of the same columns without ``key``."""
    top = df.agg(F.max(key)).first()[0]
    out = df
    while top:
        names = [c for c in out.columns if c != key]
        part = out.withColumn(key, F.floor(F.col(key) / radix).cast("long"))
        out = part.groupBy(key).applyInPandas(lambda k, pdf: merge(pdf[names]).assign(**{key: k[0]}), schema)
        top //= radix
    return out


def sample_sort(df: DataFrame, *columns: str) -> DataFrame:
    """Global order by sampled range partitioning and a sort of each range."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def global_rank(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``rank`` from 0 in the order of ``columns``: a sample sort, ranks within its ranges,
    and prefix sums over the ranges' sizes (one small row a range)."""
    from ..plans.rounds import shared_table

    ranged = shared_table(df.repartitionByRange(*columns).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*columns))
    return ranged.withColumn("__own", own).join(before, "__range").withColumn("rank", F.col("__before") + F.col("__own") - 1).drop("__range", "__before", "__own")


def kd_tree(points: DataFrame, depth: int, accuracy: int = 10_000) -> tuple[DataFrame, list[dict]]:
    """Split points at approximate medians, axis by axis, ``depth`` times.

    Returns the points with their ``leaf`` (bits of the path) and the inner nodes
    (level, leaf, axis, cut); a level is one aggregation with at most 2**level groups.
    """
    out, nodes = points.withColumn("leaf", F.lit(0)), []
    for level in range(depth):
        axis = "xyz"[level % 3]
        rows = out.groupBy("leaf").agg(F.percentile_approx(axis, 0.5, accuracy).alias("cut")).collect()  # at most 2**level rows
        nodes += [{"level": level, "leaf": r.leaf, "axis": axis, "cut": r.cut} for r in rows]
        cuts = F.broadcast(points.sparkSession.createDataFrame([(r.leaf, float(r.cut)) for r in rows], "leaf int, cut double")) if rows else None
        if cuts is None:
            break
        out = out.join(cuts, "leaf").withColumn("leaf", F.col("leaf") * 2 + (F.col(axis) > F.col("cut")).cast("int")).drop("cut")
    return out, nodes


def kd_search(nodes: list[dict], depth: int, x: float, y: float, z: float) -> int:
    """The leaf of a position."""
    at, cuts, p = 0, {(n["level"], n["leaf"]): n for n in nodes}, {"x": x, "y": y, "z": z}
    for level in range(depth):
        n = cuts.get((level, at))
        at = at * 2 + int(n is not None and p[n["axis"]] > n["cut"])
    return at


def seeds_in_range(seeds: DataFrame, groups: DataFrame) -> DataFrame:
    """Per time group (group, tmin, tmax): the number of seeds with tmin <= t <= tmax and whether
    there is any.  Groups are few and broadcast; every seed is read once."""
    hit = seeds.join(F.broadcast(groups), F.col("t").between(F.col("tmin"), F.col("tmax")))
    counts = hit.groupBy("group").agg(F.count("*").alias("n_seeds"))
    return groups.join(counts, "group", "left").select("group", "tmin", "tmax", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"), F.col("n_seeds").isNotNull().alias("has_seeds"))
