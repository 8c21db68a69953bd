"""Point location and interpolation on regular grids.

A point's cell is arithmetic on its coordinates, so sampling is an equi-join on
node coordinates, never a range join.  ``sample`` sends each point to its eight
(or sixteen, between time steps) nodes and adds the weighted values up again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..field import FlowField
from .transform import in_box

_P = ("x", "y", "z")
#: A field of at most so many bytes may be broadcast to its points; above, the join shuffles.
BROADCAST_BYTES = 64 << 20


def grid_coordinate(name: str, lo: float, spacing: float) -> Column:
    return (F.col(name) - F.lit(float(lo))) / F.lit(float(spacing))


def locate_cells(points: DataFrame, field: FlowField) -> DataFrame:
    """``points`` with cell corner (ci, cj, ck), cell id and local coordinates (a, b, c).

    The upper faces belong to the last cell.  Outside the grid the cell is -1
    and the others are null.
    """
    nx, ny, nz = field.dims
    inside = in_box(field.lo, field.hi)
    out = points
    for p, c, n, lo, s in zip(_P, "ijk", field.dims, field.lo, field.spacing, strict=True):
        cell = F.least(F.floor(grid_coordinate(p, lo, s)), F.lit(max(n - 2, 0))).cast("int")
        out = out.withColumn(f"c{c}", F.when(inside, cell))
    for p, c, f, lo, s in zip(_P, "ijk", "abc", field.lo, field.spacing, strict=True):
        out = out.withColumn(f, grid_coordinate(p, lo, s) - F.col(f"c{c}"))
    cells = F.col("ck").cast("long") * ((nx - 1) * (ny - 1)) + F.col("cj") * (nx - 1) + F.col("ci")
    return out.withColumn("cell", F.coalesce(cells, F.lit(-1).cast("long")))


def cell_vertices(cells: DataFrame, field: FlowField) -> DataFrame:
    """(ci, cj, ck) rows exploded to their eight corners: corner (x fastest), i, j, k, node."""
    nx, ny, _ = field.dims
    corners = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(n & 1).alias("a"), F.lit(n >> 1 & 1).alias("b"), F.lit(n >> 2).alias("c")) for n in range(8)))
    out = cells.withColumn("__c", F.explode(corners))
    out = out.withColumns({"corner": F.col("__c.n"), **{x: F.col(f"c{x}") + F.col(f"__c.{y}") for x, y in zip("ijk", "abc", strict=True)}}).drop("__c")
    return out.withColumn("node", F.col("k").cast("long") * (nx * ny) + F.col("j") * nx + F.col("i"))


def vertex_position(df: DataFrame, field: FlowField) -> DataFrame:
    """(i, j, k) to (x, y, z); null outside the grid."""
    ok = F.lit(True)
    for c, n in zip("ijk", field.dims, strict=True):
        ok = ok & F.col(c).between(0, n - 1)
    return df.withColumns({p: F.when(ok, F.lit(float(lo)) + F.col(c) * F.lit(float(s))) for p, c, lo, s in zip(_P, "ijk", field.lo, field.spacing, strict=True)})


def lerp(a: Column, b: Column, s: Column) -> Column:
    return a * (F.lit(1.0) - s) + b * s


def bilerp(v: tuple[Column, ...], a: Column, b: Column) -> Column:
    """Corners in x-fastest order."""
    return lerp(lerp(v[0], v[1], a), lerp(v[2], v[3], a), b)


def trilerp(v: tuple[Column, ...], a: Column, b: Column, c: Column) -> Column:
    return lerp(bilerp(v[:4], a, b), bilerp(v[4:], a, b), c)


def barycentric(v: tuple[Column, ...], b1: Column, b2: Column, b3: Column) -> Column:
    """Value in a tetrahedron from the natural coordinates of vertices 1 to 3."""
    return v[0] * (F.lit(1.0) - b1 - b2 - b3) + v[1] * b1 + v[2] * b2 + v[3] * b3


def _nodes(field: FlowField):
    return F.broadcast(field.nodes) if field.size_bytes() <= BROADCAST_BYTES else field.nodes


def node_values(keys: DataFrame, field: FlowField) -> DataFrame:
    """Values at (i, j, k, t) keys; null where there is no such node."""
    return keys.join(_nodes(field), ["t", "i", "j", "k"], "left")


def cell_values(cells: DataFrame, field: FlowField) -> DataFrame:
    """Values at the eight corners of (t, ci, cj, ck) cells."""
    return node_values(cell_vertices(cells, field), field)


def sample(points: DataFrame, field: FlowField, key: str = "point_id") -> DataFrame:
    """``points`` (x, y, z[, t] and any other columns) with the (u, v, w) there, interpolated in
    space and between the steps around t; null outside the grid or time range.

    Every row is sampled by itself, so ``key`` may repeat or be null.  The last
    step holds at and after its own time only at the range's end; a field of
    one step ignores t.  A row's corners stay in its task, which adds them up
    before the only exchange.
    """
    t0, t1 = field.t_range
    at = F.col("t") if "t" in points.columns and field.time_varying else F.lit(float(t0))
    rows = points.select(F.monotonically_increasing_id().alias("__row"), F.struct(*points.columns).alias("__point"), *_P, at.cast("double").alias("__t"))
    rows = locate_cells(rows, field)
    ok = (F.col("cell") >= 0) & F.col("__t").between(t0, t1)
    low = F.floor("__t").cast("int")
    part = F.col("__t") - low
    steps = F.array(F.struct(low.alias("t"), (F.lit(1.0) - part).alias("share")), F.struct(F.least(low + 1, F.lit(t1)).alias("t"), part.alias("share")))
    if not field.time_varying:
        steps = F.array(F.struct(F.lit(t0).alias("t"), F.lit(1.0).alias("share")))
    steps = F.filter(steps, lambda s: s["share"] != 0)
    rows = rows.select("__row", "__point", "ci", "cj", "ck", "a", "b", "c", F.explode_outer(F.when(ok, steps)).alias("s"))
    corners = cell_vertices(rows.select("__row", "__point", F.col("s.t").alias("t"), F.col("s.share").alias("share"), "ci", "cj", "ck", "a", "b", "c"), field)
    weight = F.col("share")
    for bit, f in enumerate("abc"):
        weight = weight * F.when(F.shiftright("corner", bit).bitwiseAND(F.lit(1)) == 1, F.col(f)).otherwise(F.lit(1.0) - F.col(f))
    valued = corners.withColumn("weight", weight).join(_nodes(field), ["t", "i", "j", "k"], "left")
    sums = valued.groupBy("__row", "__point").agg(*(F.sum(F.col("weight") * F.col(v)).alias(v) for v in ("u", "v", "w")))
    return sums.select("__point.*", "u", "v", "w")


def at_places(points: DataFrame, names: list[str], found: DataFrame) -> DataFrame:
    """``points`` with the columns of ``found``, one row a place (``names``); null where it has none."""
    right = found.withColumnsRenamed({n: f"__{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & (F.col(n) == F.col(f"__{n}"))
    return points.join(right, on, "left").drop(*(f"__{n}" for n in names))


def cell_volume(field: FlowField) -> float:
    dx, dy, dz = field.spacing
    return dx * dy * dz


def clip_to_box(df: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """For segments (x, y, z) to (x1, y1, z1) that begin inside the box: ``s``, the share of the
    segment up to the box (1 if it ends inside), and the point there (xb, yb, zb)."""
    shares = []
    for p, a, b in zip(_P, lo, hi, strict=True):
        d = F.col(f"{p}1") - F.col(p)
        shares.append(F.when(d > 0, (F.lit(float(b)) - F.col(p)) / d).when(d < 0, (F.lit(float(a)) - F.col(p)) / d).otherwise(F.lit(1.0)))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), *shares))
    out = df.withColumn("s", s)
    return out.withColumns({f"{p}b": F.col(p) + F.col("s") * (F.col(f"{p}1") - F.col(p)) for p in _P})
