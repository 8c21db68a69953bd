"""Iso-surfaces and critical-point cells.

Cells that a value passes through are a declarative filter; only those reach
the kernel.  A cell is cut into six tetrahedra about one diagonal, in the same
way for all cells, and each tetrahedron gives no, one or two triangles, so
surfaces of neighbouring cells meet without cracks and no case table is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..field import FlowField

_TETS = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))
_CORNERS = np.array([[n & 1, n >> 1 & 1, n >> 2] for n in range(8)], float)


def cells_of(field: FlowField, columns: Sequence[str]) -> DataFrame:
    """Cells (t, ci, cj, ck) with ``<column><corner>``: each node goes to its up to eight cells, one shuffle."""
    nx, ny, nz = field.dims
    offsets = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(n >> m & 1).alias(q) for m, q in enumerate("abc"))) for n in range(8)))
    rows = field.nodes.select("t", "i", "j", "k", *columns, F.explode(offsets).alias("o"))
    rows = rows.select("t", *columns, "o.n", *((F.col(p) - F.col(f"o.{q}")).alias(f"c{p}") for p, q in zip("ijk", "abc", strict=True)))
    rows = rows.where(F.col("ci").between(0, nx - 2) & F.col("cj").between(0, ny - 2) & F.col("ck").between(0, nz - 2))
    return rows.groupBy("t", "ci", "cj", "ck").agg(*(F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for c in columns for n in range(8)))


def iso_cells(field: FlowField, column: str, value: float) -> DataFrame:
    """Cells whose corner values lie on both sides of ``value``, or touch it."""
    names = [f"{column}{n}" for n in range(8)]
    return cells_of(field, [column]).where((F.least(*names) <= value) & (F.greatest(*names) >= value))


def iso_surface(field: FlowField, column: str, values: Sequence[float]) -> DataFrame:
    """Triangles (t, iso, ci, cj, ck, x0..z2, nx, ny, nz) of every step; the normal points to larger values."""
    lo, spacing = np.array(field.lo), np.array(field.spacing)
    names = [f"{column}{n}" for n in range(8)]
    cells = cells_of(field, [column]).withColumn("iso", F.explode(F.array(*(F.lit(float(v)) for v in values))))
    cells = cells.where((F.least(*names) <= F.col("iso")) & (F.greatest(*names) > F.col("iso")))
    points = [f"{p}{n}" for n in range(3) for p in "xyz"]

    def run(parts):
        for pdf in parts:
            s = pdf[names].to_numpy(float) - pdf["iso"].to_numpy(float)[:, None]
            base = pdf[["ci", "cj", "ck"]].to_numpy(float)
            keys = pdf[["t", "iso", "ci", "cj", "ck"]]
            out = []
            for tet in _TETS:
                v, at = s[:, tet], base[:, None] + _CORNERS[list(tet)]
                above = v > 0
                n = above.sum(1)
                cut = lambda r, a, b, v=v, at=at: at[r, a] + (v[r, a] / (v[r, a] - v[r, b]))[:, None] * (at[r, b] - at[r, a])
                for lone, side in ((1, True), (3, False)):
                    r = np.flatnonzero(n == lone)
                    if len(r):
                        a = np.argmax(above[r] == side, 1)
                        rest = np.array([[m for m in range(4) if m != q] for q in range(4)])[a]
                        out.append((r, cut(r, a, rest[:, 0]), cut(r, a, rest[:, 1]), cut(r, a, rest[:, 2])))
                r = np.flatnonzero(n == 2)
                if len(r):
                    order = np.argsort(~above[r], axis=1, kind="stable")
                    a, b, c, d = order.T
                    ac, ad, bc, bd = cut(r, a, c), cut(r, a, d), cut(r, b, c), cut(r, b, d)
                    out += [(r, ac, ad, bd), (r, ac, bd, bc)]
            if not out:
                continue
            row = np.concatenate([o[0] for o in out])
            tri = np.stack([np.concatenate([o[m] for o in out]) for m in (1, 2, 3)], 1) * spacing + lo
            normal = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
            size = np.linalg.norm(normal, axis=1)
            use = size > 0
            row, tri, normal = row[use], tri[use], normal[use] / size[use, None]
            corner = s[row]
            slope = np.stack([corner[:, [1, 3, 5, 7]].sum(1) - corner[:, [0, 2, 4, 6]].sum(1), corner[:, [2, 3, 6, 7]].sum(1) - corner[:, [0, 1, 4, 5]].sum(1), corner[:, 4:].sum(1) - corner[:, :4].sum(1)], 1)
            flip = (normal * slope).sum(1) < 0
            tri[flip] = tri[flip][:, [0, 2, 1]]
            normal[flip] *= -1
            res = keys.iloc[row].reset_index(drop=True)
            res[points] = tri.reshape(-1, 9)
            res[["nx", "ny", "nz"]] = normal
            yield res

    schema = "t int, iso double, ci int, cj int, ck int, " + ", ".join(f"{p} double" for p in [*points, "nx", "ny", "nz"])
    return cells.select("t", "iso", "ci", "cj", "ck", *names).mapInPandas(run, schema)


def critical_cells(field: FlowField) -> DataFrame:
    """Cells in which every component changes sign or is zero at a corner: the candidates of critical points."""
    cells = cells_of(field, ["u", "v", "w"])
    for c in ("u", "v", "w"):
        names = [f"{c}{n}" for n in range(8)]
        cells = cells.where((F.least(*names) <= 0) & (F.greatest(*names) >= 0))
    return cells


def critical_points(field: FlowField, rounds: int = 30) -> DataFrame:
    """(t, x, y, z, j00..j22): zeros of the trilinear field by Newton's method in each candidate cell."""
    lo, spacing = np.array(field.lo), np.array(field.spacing)
    names = [f"{c}{n}" for n in range(8) for c in ("u", "v", "w")]

    def run(parts):
        for pdf in parts:
            v = pdf[names].to_numpy(float).reshape(-1, 8, 3)
            local, ok = np.full((len(v), 3), 0.5), np.zeros(len(v), bool)
            for _ in range(rounds):
                value, slope = _blend(v, local)
                good = np.abs(np.linalg.det(slope)) > 1e-14
                move = np.zeros_like(local)
                move[good] = -np.linalg.solve(slope[good], value[good, :, None])[:, :, 0]
                local = np.clip(local + move, -1, 2)
                ok = good & (np.abs(move).max(1) < 1e-10)
            use = ok & (local >= -1e-9).all(1) & (local < 1 - 1e-9).all(1)
            _, slope = _blend(v[use], local[use])
            at = (pdf.loc[use, ["ci", "cj", "ck"]].to_numpy(float) + local[use]) * spacing + lo
            out = pd.DataFrame({"t": pdf.loc[use, "t"].to_numpy(), **{p: at[:, n] for n, p in enumerate("xyz")}})
            for r in range(3):
                for c in range(3):
                    out[f"j{r}{c}"] = slope[:, r, c] / spacing[c]
            yield out

    schema = "t int, x double, y double, z double, " + ", ".join(f"j{r}{c} double" for r in range(3) for c in range(3))
    return critical_cells(field).select("t", "ci", "cj", "ck", *names).mapInPandas(run, schema)


def _blend(v: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = [(1 - local[:, n, None], local[:, n, None]) for n in range(3)]
    value = sum(w[0][n & 1] * w[1][n >> 1 & 1] * w[2][n >> 2] * v[:, n] for n in range(8))
    d = [sum((1 if n >> m & 1 else -1) * np.prod([w[q][n >> q & 1] for q in range(3) if q != m], axis=0) * v[:, n] for n in range(8)) for m in range(3)]
    return value, np.stack(d, 2)
