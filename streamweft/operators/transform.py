"""Elementwise transforms, predicates, slices and boundary regions of a field."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..field import FlowField
from ..functions.linalg import norm, unit, vec
from ..schema import STATIONARY, Axis

_V = ("u", "v", "w")
_S = ("su", "sv", "sw")


def _has_spread(field: FlowField) -> bool:
    return set(_S) <= set(field.nodes.columns)


def scale_field(field: FlowField, s: float) -> FlowField:
    """Velocities times ``s``; an uncertain field's deviations too."""
    names = _V + (_S if _has_spread(field) else ())
    return field.with_nodes(field.nodes.withColumns({c: F.col(c) * F.lit(float(s)) for c in names}))


def translate_field(field: FlowField, dx: float, dy: float, dz: float) -> FlowField:
    """A constant added to every velocity; deviations stay."""
    return field.with_nodes(field.nodes.withColumns({c: F.col(c) + F.lit(float(d)) for c, d in zip(_V, (dx, dy, dz), strict=True)}))


def normalize_local(field: FlowField) -> FlowField:
    """Unit vectors; zero stays zero.  A field that is normalised already is returned as it is."""
    if field.normalized:
        return field
    return field.with_nodes(field.nodes.withColumns(dict(zip(_V, unit(vec(*_V)), strict=True))), normalized=True)


def normalize_global(field: FlowField) -> FlowField:
    """All velocities over the largest magnitude of all steps (one row, broadcast)."""
    if field.normalized:
        return field
    largest = field.nodes.agg(F.max(norm(vec(*_V))).alias("__largest"))
    nodes = field.nodes.join(F.broadcast(largest))
    nodes = nodes.withColumns({c: F.when(F.col("__largest") == 0, F.col(c)).otherwise(F.col(c) / F.col("__largest")) for c in _V})
    return field.with_nodes(nodes.drop("__largest"), normalized=True)


def scan_field(field: FlowField, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> FlowField:
    """Apply a user function to batches of nodes; it returns the batch with the same columns."""
    schema = field.nodes.schema
    return field.with_nodes(field.nodes.mapInPandas(lambda parts: map(fn, parts), schema))


def magnitude() -> Column:
    return norm(vec(*_V))


def max_component(*names: str) -> Column:
    return F.greatest(*names)


def clamp(name: str) -> Column:
    """At most one."""
    return F.least(F.col(name), F.lit(1.0))


def in_box(lo: tuple, hi: tuple, names: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """Inclusive at both ends; pass four names and bounds to test time too."""
    out = F.lit(True)
    for n, a, b in zip(names, lo, hi, strict=True):
        out = out & F.col(n).between(float(a), float(b))
    return out


def stationary(names: tuple[str, str, str] = _V, cutoff: float = STATIONARY) -> Column:
    return (F.abs(names[0]) < cutoff) & (F.abs(names[1]) < cutoff) & (F.abs(names[2]) < cutoff)


def slice_at(field: FlowField, axis: Axis, index: int, t: int | None = None) -> DataFrame:
    """The nodes of one axis-aligned slice; ``index`` and ``t`` reach the scan as filters."""
    nodes = field.nodes.where(F.col(axis.value) == index)
    return nodes if t is None else nodes.where(F.col("t") == t)


def _flow(kind: str, value: Column) -> Column:
    return {"inflow": value > 0, "outflow": value < 0, "tangential": value == 0}[kind]


def boundary_region(field: FlowField, kind: str) -> DataFrame:
    """Boundary nodes with inward flow ("inflow"), outward ("outflow") or neither ("tangential").

    Faces are judged each by itself, so an edge or corner node can occur once a
    face.  One pass: a node explodes to the faces that it lies on.
    """
    faces = []
    for axis, v, n in zip("ijk", _V, field.dims, strict=True):
        faces.append(F.when((F.col(axis) == 0) & _flow(kind, F.col(v)), F.lit(f"{axis}0")))
        faces.append(F.when((F.col(axis) == n - 1) & _flow(kind, -F.col(v)), F.lit(f"{axis}1")))
    return field.nodes.select("t", "i", "j", "k", *_V, F.explode(F.array_compact(F.array(*faces))).alias("face"))


def slice_region(field: FlowField, axis: Axis, index: int, kind: str) -> DataFrame:
    """Nodes of a slice by the sign of the flow along +axis."""
    v = dict(zip("ijk", _V, strict=True))[axis.value]
    return field.nodes.where((F.col(axis.value) == index) & _flow(kind, F.col(v)))


def lowpass(field: FlowField, column: str = "u") -> DataFrame:
    """3x3 weighting (1 2 1 by 1 2 1) of ``column`` in each (t, k) plane, renormalised at
    borders, computed from the input values.  One shuffle: each node sends its value to
    its plane neighbours, and weights add up before and after the exchange."""
    nx, ny, _ = field.dims
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float((2 - abs(a)) * (2 - abs(b)))).alias("weight")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    sent = field.nodes.select("t", "k", "i", "j", F.col(column).alias("value"), F.explode(offsets).alias("o"))
    sent = sent.select("t", "k", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("value") * F.col("o.weight")).alias("part"), F.col("o.weight").alias("weight"))
    sent = sent.where(F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1))
    return sent.groupBy("t", "i", "j", "k").agg((F.sum("part") / F.sum("weight")).alias(column))


def lowpass_in_place(plane: pd.DataFrame, column: str = "u") -> pd.DataFrame:
    """The order-dependent variant for one (t, k) plane: nodes are replaced in x-fastest order
    and later ones read the new values.  Use with ``groupBy("t", "k").applyInPandas``."""
    grid = plane.pivot(index="j", columns="i", values=column).to_numpy(copy=True)
    ny, nx = grid.shape
    for y in range(ny):
        for x in range(nx):
            total = weight = 0.0
            for b in (-1, 0, 1):
                for a in (-1, 0, 1):
                    if 0 <= x + a < nx and 0 <= y + b < ny:
                        f = (2 - abs(a)) * (2 - abs(b))
                        total += f * grid[y + b, x + a]
                        weight += f
            grid[y, x] = total / weight
    out = plane.copy()
    out[column] = grid[out["j"].to_numpy(), out["i"].to_numpy()]
    return out


def momentum_to_velocity(df: DataFrame) -> DataFrame:
    """(rho, mx, my, mz) to (u, v, w); zero where the density is."""
    return df.withColumns({v: F.when(F.col("rho") == 0, F.lit(0.0)).otherwise(F.col(m) / F.col("rho")) for v, m in zip(_V, ("mx", "my", "mz"), strict=True)})
