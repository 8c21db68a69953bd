"""Operators on trace points (seed_id, dir, seq, x, y, z, t)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import cross, dot, norm, sub, unit, vec

_P = ("x", "y", "z")


def _line(*order: str) -> Window:
    return Window.partitionBy("seed_id", "dir").orderBy(*order)


def time_slab(points: DataFrame, t0: float, t1: float) -> DataFrame:
    """The parts of the lines with t0 <= t <= t1; segments that cross an end are cut there by
    linear interpolation.  Rows: seed_id, dir, seq, x0..t0, x1..t1 of each remaining segment."""
    w = _line("seq")
    names = (*_P, "t")
    seg = points.select("seed_id", "dir", F.lag("seq").over(w).alias("seq"), *(F.lag(p).over(w).alias(f"{p}0") for p in names), *(F.col(p).alias(f"{p}1") for p in names))
    seg = seg.where(F.col("seq").isNotNull() & (F.least("t0", "t1") <= t1) & (F.greatest("t0", "t1") >= t0))
    span = F.col("t1") - F.col("t0")

    def share(t: Column) -> Column:
        return F.when(span == 0, F.lit(0.0)).otherwise((t - F.col("t0")) / span)

    a = share(F.greatest(F.lit(float(t0)), F.least(F.lit(float(t1)), F.col("t0"))))
    b = F.when(span == 0, F.lit(1.0)).otherwise(share(F.greatest(F.lit(float(t0)), F.least(F.lit(float(t1)), F.col("t1")))))
    at = lambda p, s: F.col(f"{p}0") + s * (F.col(f"{p}1") - F.col(f"{p}0"))
    return seg.select("seed_id", "dir", "seq", *(at(p, s).alias(f"{p}{n}") for n, s in ((0, a), (1, b)) for p in names))


def animation_frame(points: DataFrame, frame: int, stride: int) -> DataFrame:
    """Every ``stride``-th particle of the lines, shifted by ``frame``."""
    return points.where(F.pmod("seq", F.lit(stride)) == frame % stride)


def tangents(points: DataFrame) -> DataFrame:
    """Unit tangents: towards the next point; the last point has the one before it; null for a line of one point."""
    w = _line("seq")
    ahead = tuple(F.lead(p).over(w) for p in _P)
    behind = tuple(F.lag(p).over(w) for p in _P)
    out = points.withColumns({f"d{p}": F.coalesce(a - F.col(p), F.col(p) - b) for p, a, b in zip(_P, ahead, behind, strict=True)})
    d = vec("dx", "dy", "dz")
    return out.withColumns(dict(zip(("tx", "ty", "tz"), unit(d), strict=True))).drop("dx", "dy", "dz")


def normals(points: DataFrame) -> DataFrame:
    """Curve normals: the change of the tangent without its part along the tangent; on straight
    parts any fixed perpendicular."""
    w = _line("seq")
    out = tangents(points)
    turn = {f"c{p}": F.coalesce(F.lead(f"t{p}").over(w), F.col(f"t{p}")) - F.coalesce(F.lag(f"t{p}").over(w), F.col(f"t{p}")) for p in _P}
    out = out.withColumns(turn)
    t, c = vec("tx", "ty", "tz"), vec("cx", "cy", "cz")
    flat = sub(c, tuple(x * dot(c, t) for x in t))
    other = cross(t, (F.when(F.abs("tx") < 0.9, 1.0).otherwise(0.0), F.when(F.abs("tx") < 0.9, 0.0).otherwise(1.0), F.lit(0.0)))
    bent = norm(flat) > 1e-9
    chosen = tuple(F.when(bent, a).otherwise(b) for a, b in zip(unit(flat), unit(other), strict=True))
    return out.withColumns(dict(zip(("nx", "ny", "nz"), chosen, strict=True))).drop("cx", "cy", "cz")


def tubes(points: DataFrame, radius: float, sides: int = 6) -> DataFrame:
    """Rings of ``sides`` vertices around every point: seed_id, dir, seq, side, x, y, z and outward normal."""
    out = normals(points).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    t, n = vec("tx", "ty", "tz"), vec("nx", "ny", "nz")
    b = cross(t, n)
    angle = F.col("side") * F.lit(6.283185307179586 / sides)
    ring = tuple(p * F.cos(angle) + q * F.sin(angle) for p, q in zip(n, b, strict=True))
    return out.select("seed_id", "dir", "seq", "side", *((F.col(p) + r * F.lit(float(radius))).alias(p) for p, r in zip(_P, ring, strict=True)), *(r.alias(f"o{p}") for p, r in zip(_P, ring, strict=True)))


def colour(points: DataFrame, all_same: Sequence[float] | None = None, by_trace: DataFrame | None = None, by_point: DataFrame | None = None) -> DataFrame:
    """``points`` with r, g, b, a: one colour, one a line (seed_id, r, g, b, a), or one a point (seed_id, dir, seq, ...)."""
    if all_same is not None:
        return points.withColumns({c: F.lit(float(v)) for c, v in zip("rgba", all_same, strict=True)})
    if by_trace is not None:
        return points.join(by_trace, "seed_id", "left")
    return points.join(by_point, ["seed_id", "dir", "seq"], "left")


def with_speed(points: DataFrame, field, key: str = "point_id") -> DataFrame:
    """Lines with the velocity's magnitude at every point, for polyline export."""
    from .locate import sample

    got = sample(points.withColumn(key, F.struct("seed_id", "dir", "seq")), field, key)
    return got.withColumn("speed", norm(vec("u", "v", "w"))).drop(key, "u", "v", "w")


def pseudo_times(points: DataFrame) -> DataFrame:
    """Steady lines get t = seq / number of points."""
    n = F.count("*").over(Window.partitionBy("seed_id", "dir"))
    return points.withColumn("t", F.col("seq") / n)


def writer_offsets(points: DataFrame) -> DataFrame:
    """(seed_id, dir, n_points, first): where each line begins in a file of all points.

    Prefix sums run within hash ranges of lines and over the ranges' totals, so
    no task sees all lines."""
    counts = points.groupBy("seed_id", "dir").agg(F.count("*").alias("n_points")).withColumn("range", F.floor(F.col("seed_id") / 4096))
    own = Window.partitionBy("range").orderBy("seed_id", "dir").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("range").agg(F.sum("n_points").alias("all"))
    before = totals.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = counts.withColumn("inner", F.coalesce(F.sum("n_points").over(own), F.lit(0))).join(before, "range")
    return out.select("seed_id", "dir", "n_points", (F.col("base") + F.col("inner")).alias("first"))


def nan_separated(rows: DataFrame) -> DataFrame:
    """Lines from a point list (n, x, y, z, t) in which a row of NaN ends a line: the running count
    of such rows is the line's number.  Counts run within ranges of 65,536 rows and over the
    ranges' totals, so no task sees all rows."""
    rows = rows.withColumns({"range": F.floor(F.col("n") / 65536), "end": F.when(F.isnan("x"), 1).otherwise(0)})
    totals = rows.groupBy("range").agg(F.sum("end").alias("all"))
    before = totals.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.sum("end").over(Window.partitionBy("range").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("inner", own).join(before, "range").withColumn("seed_id", (F.col("base") + F.col("inner")).cast("long")).where("end = 0")
    w = Window.partitionBy("seed_id").orderBy("n")
    return out.select("seed_id", (F.row_number().over(w) - 1).cast("int").alias("seq"), *_P, "t")


def connect_fragments(fragments: DataFrame) -> DataFrame:
    """Join imported fragments (fragment, seq, x, y, z, t) whose first point is exactly an earlier
    fragment's last one: (trace, seq, ...).

    A fragment has one successor and one predecessor (the lowest numbers of
    equal ends); fragments of one point stay alone.  Chains close by doubling.
    """
    from ..plans.rounds import shared_table

    w = Window.partitionBy("fragment")
    size = fragments.withColumns({"n": F.count("*").over(w), "last": F.max("seq").over(w)}).where("n > 1")
    names = (*_P, "t")
    heads = size.where("seq = 0").select(F.col("fragment").alias("next"), *names)
    tails = size.where("seq = last").select(F.col("fragment").alias("prev"), *names)
    links = tails.join(heads, list(names)).where("prev < next").select("prev", "next")
    one = Window.partitionBy("next").orderBy("prev")
    links = links.withColumn("a", F.row_number().over(one)).where("a = 1")
    links = links.withColumn("b", F.row_number().over(Window.partitionBy("prev").orderBy("next"))).where("b = 1").select("prev", "next")
    start = fragments.select("fragment").distinct().join(links.withColumnRenamed("next", "fragment"), "fragment", "left")
    jump = shared_table(start.select("fragment", F.coalesce("prev", "fragment").alias("root"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("depth")), "links")
    while True:  # a link leads to a smaller number, so chains end, and each round doubles what is followed
        up = jump.select(F.col("fragment").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        moved = shared_table(jump.join(up, "root").select("fragment", F.col("higher").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "links")
        done = moved.join(jump.select("fragment", F.col("root").alias("old")), "fragment").where("root <> old").isEmpty()
        jump = moved
        if done:
            break
    rows = fragments.join(jump, "fragment").where("depth = 0 OR seq > 0")
    order = Window.partitionBy("root").orderBy("depth", "seq")
    return rows.select(F.col("root").alias("trace"), (F.row_number().over(order) - 1).cast("int").alias("seq"), *names)
