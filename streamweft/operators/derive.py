"""Differential operators and vortex metrics.

Grid stencils are lag/lead windows.  Nodes are partitioned by (t, k) once for
the x and y neighbours and by (t, j) once for the z neighbours: two exchanges,
not three, and no key holds more than one plane.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..field import FlowField
from ..functions.linalg import cross, det3, dot, inv3, mat, matadd, matmul, matscale, matsub, matvec, norm, symmetric_eigenvalues, trace, transpose, unit, vec
from .locate import at_places, sample

_V = ("u", "v", "w")


def with_neighbours(field: FlowField, columns: tuple[str, ...] = _V) -> DataFrame:
    """Nodes with ``<column>_<axis>m`` and ``..p``: the values before and after on each axis, null at faces."""
    df, time = field.nodes, ("t",) if field.time_varying else ()
    for axis, layout, others in (("i", "k", ("t", "k", "j")), ("j", "k", ("t", "k", "i")), ("k", "j", ("t", "j", "i"))):
        if axis != "j":  # a constant t drops out of a window's keys, so it must not be a key of the layout
            df = df.repartition(*time, layout)
        w = Window.partitionBy(*others).orderBy(axis)
        df = df.select("*", *(f(c).over(w).alias(f"{c}_{axis}{s}") for c in columns for f, s in ((F.lag, "m"), (F.lead, "p"))))
    return df


def _difference(column: str, axis: str, h: float) -> Column:
    """Central difference; one-sided over one spacing at a face; zero on an axis of one node."""
    before, after, own = F.col(f"{column}_{axis}m"), F.col(f"{column}_{axis}p"), F.col(column)
    steps = F.when(before.isNull() | after.isNull(), F.lit(float(h))).otherwise(F.lit(2.0 * float(h)))
    return (F.coalesce(after, own) - F.coalesce(before, own)) / steps


def curl_of(d: dict[tuple[str, str], Column]) -> tuple[Column, Column, Column]:
    """Curl from the partial derivatives, keyed by (component, axis)."""
    return d["w", "j"] - d["v", "k"], d["u", "k"] - d["w", "i"], d["v", "i"] - d["u", "j"]


def _partials(field: FlowField) -> dict[tuple[str, str], Column]:
    return {(c, a): _difference(c, a, h) for c in _V for a, h in zip("ijk", field.spacing, strict=True)}


def vorticity(field: FlowField, normalize: bool = False) -> FlowField:
    """The curl at every node; ``normalize`` makes vectors longer than 1e-6 unit."""
    out = with_neighbours(field).select("t", "i", "j", "k", *(c.alias(n) for c, n in zip(curl_of(_partials(field)), _V, strict=True)))
    if normalize:
        out = out.withColumns({c: F.when(norm(vec(*_V)) > 1e-6, x).otherwise(F.col(c)) for c, x in zip(_V, unit(vec(*_V)), strict=True)})
    return field.with_nodes(out)


def laplacian(field: FlowField) -> FlowField:
    """Seven-point Laplacian of each component at interior nodes; zero at the boundary."""
    inner = F.lit(True)
    for a, n in zip("ijk", field.dims, strict=True):
        inner = inner & F.col(a).between(1, n - 2)
    parts = {}
    for c in _V:
        terms = [(F.col(f"{c}_{a}m") - F.lit(2.0) * F.col(c) + F.col(f"{c}_{a}p")) / F.lit(float(h) * float(h)) for a, h in zip("ijk", field.spacing, strict=True)]
        parts[c] = F.when(inner, terms[0] + terms[1] + terms[2]).otherwise(F.lit(0.0))
    return field.with_nodes(with_neighbours(field).select("t", "i", "j", "k", *(x.alias(c) for c, x in parts.items())))


def jacobian_nodes(field: FlowField) -> DataFrame:
    """Nodes with (u, v, w) and the velocity gradient j00..j22 (row: component, column: axis)."""
    d = _partials(field)
    return with_neighbours(field).select("t", "i", "j", "k", *_V, *(d[c, a].alias(f"j{r}{s}") for r, c in enumerate(_V) for s, a in enumerate("ijk")))


def jacobian_curvilinear(field: FlowField, vertices: DataFrame) -> DataFrame:
    """The gradient on a structured grid with explicit vertices: index-space differences
    times the inverse of the vertex positions' index-space gradient."""
    index = FlowField.of(field.nodes, field.dims, t_range=field.t_range)
    values = {f"d{r}{s}": _difference(c, a, 1.0) for r, c in enumerate(_V) for s, a in enumerate("ijk")}
    flow = with_neighbours(index).select("t", "i", "j", "k", *_V, *(x.alias(n) for n, x in values.items()))
    shape = FlowField.of(vertices.withColumn("t", F.lit(0)), field.dims)
    places = {f"g{r}{s}": _difference(c, a, 1.0) for r, c in enumerate("xyz") for s, a in enumerate("ijk")}
    shape_ = with_neighbours(shape, ("x", "y", "z")).select("i", "j", "k", *(x.alias(n) for n, x in places.items()))
    both = flow.join(shape_, ["i", "j", "k"])
    j = matmul(mat("d"), inv3(mat("g")))
    return both.select("t", "i", "j", "k", *_V, *(j[r][s].alias(f"j{r}{s}") for r in range(3) for s in range(3)))


def jacobian_at(points: DataFrame, field: FlowField, delta: float = 0.1, key: str = "point_id") -> DataFrame:
    """The gradient at points by probes ``delta`` before and after on each axis; one-sided where
    one probe is outside, null where both are or the point is."""
    shifts = [(0, 0, 0)] + [tuple(s if a == b else 0 for b in range(3)) for a in range(3) for s in (-1, 1)]
    probes = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(float(d) * delta).alias(p) for p, d in zip("xyz", s, strict=True))) for n, s in enumerate(shifts)))
    names = ["x", "y", "z", *(["t"] if "t" in points.columns else [])]
    sent = points.select(*names).distinct().select(F.struct(*names).alias("place"), *names, F.explode(probes).alias("p"))
    sent = sent.select("place", F.col("p.n").alias("n"), *((F.col(p) + F.col(f"p.{p}")).alias(p) for p in "xyz"), *names[3:])
    wide = sample(sent, field).groupBy("place").agg(*(F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in range(7) for c in _V))
    columns = []
    for r, c in enumerate(_V):
        for a in range(3):
            own, before, after = F.col(f"{c}0"), F.col(f"{c}{1 + 2 * a}"), F.col(f"{c}{2 + 2 * a}")
            sides = F.when(before.isNotNull() & after.isNotNull(), (after - before) / F.lit(2 * delta))
            sides = sides.when(after.isNotNull(), (after - own) / F.lit(delta)).when(before.isNotNull(), (own - before) / F.lit(delta))
            columns.append(F.when(own.isNotNull(), sides).alias(f"j{r}{a}"))
    return at_places(points, names, wide.select("place.*", *columns))


def curl_at(points: DataFrame, field: FlowField, key: str = "point_id") -> DataFrame:
    """The curl at points from samples at the grid planes around them, or one spacing away at
    a plane; null where a needed plane is outside."""
    arms = []
    for a, (p, lo, s) in enumerate(zip("xyz", field.lo, field.spacing, strict=True)):
        g = (F.col(p) - F.lit(float(lo))) / F.lit(float(s))
        low = F.when(F.floor(g) == g, g - 1.0).otherwise(F.floor(g).cast("double"))
        high = F.when(F.floor(g) == g, g + 1.0).otherwise(F.ceil(g).cast("double"))
        for side, q in enumerate((low, high)):
            moved = F.lit(float(lo)) + q * F.lit(float(s))
            arms.append(F.struct(F.lit(2 * a + side).alias("n"), *((moved if b == a else F.col(c)).alias(c) for b, c in enumerate("xyz"))))
    names = ["x", "y", "z", *(["t"] if "t" in points.columns else [])]
    sent = points.select(*names).distinct().select(F.struct(*names).alias("place"), *names[3:], F.explode(F.array(*arms)).alias("p"))
    sent = sent.select("place", "p.n", *(F.col(f"p.{p}").alias(p) for p in "xyz"), *names[3:])
    wide = sample(sent, field).groupBy("place").agg(*(F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in range(6) for c in (*_V, "xyz"[n // 2])))
    d = {(c, axis): (F.col(f"{c}{2 * a + 1}") - F.col(f"{c}{2 * a}")) / (F.col(f"{'xyz'[a]}{2 * a + 1}") - F.col(f"{'xyz'[a]}{2 * a}")) for c in _V for a, axis in enumerate("ijk")}
    curl = curl_of(d)
    return at_places(points, names, wide.select("place.*", *(x.alias(n) for x, n in zip(curl, ("curl_x", "curl_y", "curl_z"), strict=True))))


def vortex_metrics(df: DataFrame) -> DataFrame:
    """``df`` (with j00..j22) and q, delta, lambda2, gamma2; gamma2 is null without strain (below 1e-12).

    S and R are the gradient's symmetric and antisymmetric parts, M = S S + R R:
    q = -trace(M) / 2, delta = (q / 3)**3 + (det J / 2)**2, lambda2 the middle
    eigenvalue of M, gamma2 = |R's vector| over the largest eigenvalue of S.
    """
    j = mat()
    s, r = matscale(matadd(j, transpose(j)), 0.5), matscale(matsub(j, transpose(j)), 0.5)
    m = matadd(matmul(s, s), matmul(r, r))
    q = trace(m) * F.lit(-0.5)
    half = det3(j) / F.lit(2.0)
    third = q / F.lit(3.0)
    spin = F.sqrt(r[0][1] * r[0][1] + r[0][2] * r[0][2] + r[1][2] * r[1][2])
    strain = symmetric_eigenvalues(s)[0]
    return df.withColumns({
        "q": q, "delta": third * third * third + half * half, "lambda2": symmetric_eigenvalues(m)[1],
        "gamma2": F.when(F.abs(strain) > 1e-12, F.abs(spin / strain)),
    })


def gradient_scalars(df: DataFrame) -> DataFrame:
    """``df`` (with u, v, w and j00..j22), divergence, det_j and speed."""
    return df.withColumns({"divergence": trace(mat()), "det_j": det3(mat()), "speed": norm(vec(*_V))})


def curvature(df: DataFrame) -> DataFrame:
    """``df`` (with u, v, w and j00..j22) and curvature: |J t| for the unit tangent t; zero where the flow stands."""
    return df.withColumn("curvature", norm(matvec(mat(), unit(vec(*_V)))))


def trace_metrics(points: DataFrame, field: FlowField, delta: float = 0.1) -> DataFrame:
    """Vortex metrics and curvature at every point of ``points`` (seed_id, dir, seq, x, y, z, t)."""
    keyed = points.withColumn("point_id", F.struct("seed_id", "dir", "seq"))
    return curvature(vortex_metrics(jacobian_at(sample(keyed, field), field, delta))).drop("point_id")


def triple_product(a: tuple, b: tuple, c: tuple) -> Column:
    return dot(a, cross(b, c))


def eigen_table(df: DataFrame, prefix: str = "j") -> DataFrame:
    """``df`` with the eigenvalues of the 3x3 matrix (re0..re2, im0..im2, by falling real part,
    then imaginary part), their eigenvectors as nested arrays (vectors of real parts and of
    imaginary parts, columns normalised) and ``n_real``."""
    import numpy as np

    names = [f"{prefix}{r}{c}" for r in range(3) for c in range(3)]
    extra = "re0 double, re1 double, re2 double, im0 double, im1 double, im2 double, vectors_re array<array<double>>, vectors_im array<array<double>>, n_real int"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra

    def run(parts):
        for pdf in parts:
            m = pdf[names].to_numpy(float).reshape(-1, 3, 3)
            values, vectors = np.linalg.eig(m) if len(m) else (np.zeros((0, 3), complex), np.zeros((0, 3, 3), complex))
            order = np.lexsort((-values.imag, -np.round(values.real, 12)), axis=-1)
            values = np.take_along_axis(values, order, 1)
            vectors = np.take_along_axis(vectors, order[:, None, :], 2)
            out = pdf.copy()
            for n in range(3):
                out[f"re{n}"], out[f"im{n}"] = values[:, n].real, values[:, n].imag
            out["vectors_re"] = pd.Series([v.real.T.tolist() for v in vectors], index=pdf.index, dtype=object)
            out["vectors_im"] = pd.Series([v.imag.T.tolist() for v in vectors], index=pdf.index, dtype=object)
            out["n_real"] = (np.abs(values.imag) < 1e-12).sum(1).astype("int32")
            yield out

    return df.mapInPandas(run, schema)


def classify_critical_points(df: DataFrame) -> DataFrame:
    """``df`` (with j00..j22), its eigenvalues and ``kind``.

    Kinds count the real parts that are positive, zero counting so: source (3),
    saddle of 2 or 1, sink (0), each "node" with real and "spiral" with complex
    eigenvalues; a singular matrix is "degenerate".
    """
    e = eigen_table(df)
    positive = sum((F.when(F.col(f"re{n}") >= 0, 1).otherwise(0) for n in range(3)), F.lit(0))
    shape = F.when(F.col("n_real") == 3, "node").otherwise("spiral")
    base = F.when(positive == 3, "repelling").when(positive == 0, "attracting").when(positive == 2, "repelling_saddle").otherwise("attracting_saddle")
    return e.withColumn("kind", F.when(F.abs(det3(mat())) < 1e-12, "degenerate").otherwise(F.concat_ws("_", base, shape)))
