"""Tetrahedral meshes and curvilinear grids: adjacency, location and interpolation.

Points find cells by bins of the cells' own magnitude: a cell is listed in every
bin of its level that its box meets, a point is in one bin a level, and an
exact containment test follows the equi-join.  Ties go to the lowest cell id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import cross, dot
from .locate import at_places

_P = ("x", "y", "z")


def with_corners(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """``tets`` with the positions of their four vertices: x0..z3."""
    out = tets
    for n in range(4):
        v = vertices.select(F.col("vid").alias(f"v{n}"), *(F.col(p).alias(f"{p}{n}") for p in _P))
        out = out.join(v, f"v{n}")
    return out


def _edge(n: int) -> tuple[Column, ...]:
    return tuple(F.col(f"{p}{n}") - F.col(f"{p}0") for p in _P)


def tet_volume() -> Column:
    """A sixth of the triple product of the edges from vertex 0; signed."""
    return dot(_edge(1), cross(_edge(2), _edge(3))) / F.lit(6.0)


def hex_volume(corner: tuple[tuple[Column, ...], ...]) -> Column:
    """Volume of a hexahedron (corners x fastest) as six tetrahedra about the diagonal 0 to 7."""
    ring = (1, 3, 2, 6, 4, 5, 1)
    sub = lambda a, b: tuple(x - y for x, y in zip(corner[a], corner[b], strict=True))
    parts = [F.abs(dot(sub(a, 0), cross(sub(b, 0), sub(7, 0)))) / F.lit(6.0) for a, b in zip(ring, ring[1:], strict=False)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def natural_coordinates() -> tuple[Column, Column, Column]:
    """Barycentric weights of vertices 1 to 3 at (x, y, z); null in a degenerate tetrahedron."""
    p = tuple(F.col(c) - F.col(f"{c}0") for c in _P)
    e1, e2, e3 = _edge(1), _edge(2), _edge(3)
    d = dot(e1, cross(e2, e3))
    value = lambda a, b, c: F.when(d != 0, dot(a, cross(b, c)) / d)
    return value(p, e2, e3), value(e1, p, e3), value(e1, e2, p)


def face_adjacency(tets: DataFrame) -> DataFrame:
    """(tid, face, neighbour): for each tetrahedron and the face opposite to vertex ``face`` the
    tetrahedron behind it, null at the surface.  One shuffle on the sorted vertex triple."""
    faces = F.array(*(F.struct(F.lit(n).alias("face"), F.sort_array(F.array(*(F.col(f"v{m}") for m in range(4) if m != n))).alias("key")) for n in range(4)))
    rows = tets.select("tid", F.explode(faces).alias("f")).select("tid", "f.face", "f.key")
    w = Window.partitionBy("key")
    both = rows.withColumns({"low": F.min("tid").over(w), "high": F.max("tid").over(w)})
    other = F.when(F.col("low") == F.col("high"), F.lit(None)).when(F.col("tid") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    return both.select("tid", "face", other.cast("long").alias("neighbour"))


def _bins(low: list[Column], high: list[Column], size: Column) -> Column:
    ranges = [F.sequence(F.floor(a / size), F.floor(b / size)) for a, b in zip(low, high, strict=True)]
    return F.flatten(F.transform(ranges[0], lambda a: F.flatten(F.transform(ranges[1], lambda b: F.transform(ranges[2], lambda c: F.struct(a.alias("bx"), b.alias("by"), c.alias("bz")))))))


def _candidates(points: DataFrame, cells: DataFrame, corners: int, slack: float) -> DataFrame:
    """Pairs of points and cells whose boxes may hold them.  A cell is listed at the level whose bins
    (powers of two) are as large as its box, so in two bins an axis at most, however sizes differ;
    a point asks its bin at every level that occurs (a few, as many as there are magnitudes of sizes).
    Of a bin's cells only those stay whose own box, wider by the tolerance's share of it, holds the point."""
    low = [F.least(*(f"{p}{n}" for n in range(corners))) - slack for p in _P]
    high = [F.greatest(*(f"{p}{n}" for n in range(corners))) + slack for p in _P]
    wide = F.greatest(*(b - a for a, b in zip(low, high, strict=True)), F.lit(1e-9))
    near = F.col("__wide") * (4 * slack) + slack
    leveled = cells.withColumn("__wide", wide).withColumn("__level", F.ceil(F.log2("__wide")).cast("int"))
    levels = sorted(r[0] for r in leveled.select("__level").distinct().collect() if r[0] is not None)
    size = F.pow(F.lit(2.0), F.col("__level"))
    boxes = {f"__{s}{p}": x for s, ends in (("low", (a - near for a in low)), ("high", (b + near for b in high))) for p, x in zip(_P, ends, strict=True)}
    listed = leveled.withColumns(boxes).withColumn("__b", F.explode(_bins(low, high, size))).select("*", "__b.bx", "__b.by", "__b.bz").drop("__b", "__wide")
    placed = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    pairs = placed.withColumns({f"b{p}": F.floor(F.col(p) / size) for p in _P}).join(listed, ["__level", "bx", "by", "bz"])
    for p in _P:
        pairs = pairs.where(F.col(p).between(F.col(f"__low{p}"), F.col(f"__high{p}")))
    return pairs.drop(*boxes)


def _places(points: DataFrame) -> DataFrame:
    """Each place of ``points`` once, over all cores: a place is a few bytes but meets many cells, so
    AQE, which goes by bytes, would put all into one task."""
    return points.select(*_P).repartition(3 * points.sparkSession.sparkContext.defaultParallelism, *_P).distinct()


def _holding_tets(points: DataFrame, tets: DataFrame, vertices: DataFrame, tolerance: float) -> DataFrame:
    """Each place that a cell holds, once, with the cell, its vertices and natural coordinates."""
    found = _candidates(_places(points), with_corners(tets, vertices), 4, tolerance)
    b = natural_coordinates()
    found = found.withColumns(dict(zip(("b1", "b2", "b3"), b, strict=True)))
    inside = (F.least("b1", "b2", "b3", F.lit(1.0) - F.col("b1") - F.col("b2") - F.col("b3")) >= -tolerance) & F.col("b1").isNotNull()
    return found.where(inside).groupBy(*_P).agg(F.min(F.struct("tid", "b1", "b2", "b3", "v0", "v1", "v2", "v3")).alias("c")).select(*_P, "c.*")


def locate_tets(points: DataFrame, tets: DataFrame, vertices: DataFrame, key: str = "point_id", tolerance: float = 1e-9) -> DataFrame:
    """Points (key, x, y, z) with tid and natural coordinates (b1, b2, b3); null where no cell holds them."""
    return at_places(points, list(_P), _holding_tets(points, tets, vertices, tolerance))


def sample_tets(points: DataFrame, tets: DataFrame, vertices: DataFrame, values: DataFrame, key: str = "point_id") -> DataFrame:
    """Points with (u, v, w) of the barycentric blend of ``values`` (vid, u, v, w); ``key`` may repeat."""
    at = _holding_tets(points, tets, vertices, 1e-9)
    weights = F.array(*(F.struct(F.col(f"v{n}").alias("vid"), (F.lit(1.0) - F.col("b1") - F.col("b2") - F.col("b3") if n == 0 else F.col(f"b{n}")).alias("weight")) for n in range(4)))
    parts = at.select(*_P, F.explode(weights).alias("p")).select(*_P, "p.vid", "p.weight").join(values, "vid")
    sums = parts.groupBy(*_P).agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("u", "v", "w")))
    return at_places(points, list(_P), sums)


def tet_position(df: DataFrame) -> DataFrame:
    """(x, y, z) at natural coordinates (b1, b2, b3) of tetrahedra with corners."""
    first = F.lit(1.0) - F.col("b1") - F.col("b2") - F.col("b3")
    return df.withColumns({p: first * F.col(f"{p}0") + F.col("b1") * F.col(f"{p}1") + F.col("b2") * F.col(f"{p}2") + F.col("b3") * F.col(f"{p}3") for p in _P})


def hex_cells(vertices: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Cells (cell, ci, cj, ck, x0..z7) of a curvilinear grid: every vertex goes to its up to
    eight cells, one shuffle."""
    nx, ny, nz = dims
    offsets = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(n & 1).alias("a"), F.lit(n >> 1 & 1).alias("b"), F.lit(n >> 2).alias("c")) for n in range(8)))
    rows = vertices.withColumn("o", F.explode(offsets)).withColumns({f"c{p}": F.col(p) - F.col(f"o.{q}") for p, q in zip("ijk", "abc", strict=True)})
    rows = rows.where(F.col("ci").between(0, nx - 2) & F.col("cj").between(0, ny - 2) & F.col("ck").between(0, nz - 2))
    out = rows.groupBy("ci", "cj", "ck").agg(*(F.max(F.when(F.col("o.n") == n, F.col(p))).alias(f"{p}{n}") for n in range(8) for p in _P))
    return out.withColumn("cell", F.col("ck").cast("long") * ((nx - 1) * (ny - 1)) + F.col("cj") * (nx - 1) + F.col("ci"))


def inverse_map(corners: np.ndarray, points: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Local coordinates of points in hexahedra by Newton's method from the centre, and whether it settled."""
    local = np.full((len(points), 3), 0.5)
    settled = np.zeros(len(points), bool)
    for _ in range(rounds):
        a, b, c = (local[:, n, None] for n in range(3))
        wa, wb, wc = (1 - a, a), (1 - b, b), (1 - c, c)
        at = sum(wa[n & 1] * wb[n >> 1 & 1] * wc[n >> 2] * corners[:, n] for n in range(8))
        d = np.stack([
            sum((1 if n & 1 else -1) * wb[n >> 1 & 1] * wc[n >> 2] * corners[:, n] for n in range(8)),
            sum((1 if n >> 1 & 1 else -1) * wa[n & 1] * wc[n >> 2] * corners[:, n] for n in range(8)),
            sum((1 if n >> 2 else -1) * wa[n & 1] * wb[n >> 1 & 1] * corners[:, n] for n in range(8)),
        ], axis=2)
        ok = np.abs(np.linalg.det(d)) > 1e-14
        move = np.zeros_like(local)
        move[ok] = np.linalg.solve(d[ok], (points - at)[ok, :, None])[:, :, 0]
        local = np.clip(local + move, -2, 3)
        settled = ok & (np.abs(move).max(1) < 1e-10)
        if settled.all():
            break
    return local, settled


def locate_hexes(points: DataFrame, vertices: DataFrame, dims: tuple[int, int, int], key: str = "point_id", tolerance: float = 1e-9) -> DataFrame:
    """Points with cell, (ci, cj, ck) and local coordinates (a, b, c) on a curvilinear grid; null outside."""
    found = _candidates(_places(points), hex_cells(vertices, dims), 8, tolerance)
    names = [f"{p}{n}" for n in range(8) for p in _P]

    def run(parts):
        for pdf in parts:
            local, ok = inverse_map(pdf[names].to_numpy(float).reshape(-1, 8, 3), pdf[list(_P)].to_numpy(float))
            use = ok & (local >= -tolerance).all(1) & (local <= 1 + tolerance).all(1)
            out = pdf.loc[use, [*_P, "cell", "ci", "cj", "ck"]].copy()
            out[["a", "b", "c"]] = np.clip(local[use], 0, 1)
            yield out

    hit = found.select(*_P, "cell", "ci", "cj", "ck", *names).mapInPandas(run, "x double, y double, z double, cell long, ci int, cj int, ck int, a double, b double, c double")
    best = hit.groupBy(*_P).agg(F.min(F.struct("cell", "ci", "cj", "ck", "a", "b", "c")).alias("h")).select(*_P, "h.*")
    return at_places(points, list(_P), best)


def sample_hexes(points: DataFrame, vertices: DataFrame, nodes: DataFrame, dims: tuple[int, int, int], key: str = "point_id") -> DataFrame:
    """Points with (u, v, w) by trilinear blend in their curvilinear cell; ``key`` may repeat."""
    at = locate_hexes(points.select(*_P).distinct(), vertices, dims, key).where("cell IS NOT NULL")
    corners = F.array(*(F.struct(*(F.lit(n >> m & 1).alias(q) for m, q in enumerate("abc"))) for n in range(8)))
    rows = at.select(*_P, "ci", "cj", "ck", "a", "b", "c", F.explode(corners).alias("o"))
    weight = F.lit(1.0)
    for q in "abc":
        weight = weight * F.when(F.col(f"o.{q}") == 1, F.col(q)).otherwise(F.lit(1.0) - F.col(q))
    rows = rows.select(*_P, weight.alias("weight"), *((F.col(f"c{p}") + F.col(f"o.{q}")).alias(p) for p, q in zip("ijk", "abc", strict=True)))
    sums = rows.join(nodes.select("i", "j", "k", "u", "v", "w"), ["i", "j", "k"]).groupBy(*_P).agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("u", "v", "w")))
    return at_places(points, list(_P), sums)


def surface_box(vertices: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """The bounding box of a curvilinear grid's boundary vertices."""
    edge = F.lit(False)
    for p, n in zip("ijk", dims, strict=True):
        edge = edge | F.col(p).isin(0, n - 1)
    return vertices.where(edge).agg(*(f(p).alias(f"{p}{n}") for p in _P for f, n in ((F.min, "min"), (F.max, "max"))))


def tet_frames(pdf: pd.DataFrame) -> pd.DataFrame:
    """Inverse edge matrices m00..m22 and six volumes of a batch of tetrahedra with corners."""
    edges = np.stack([pdf[[f"{p}{n}" for p in _P]].to_numpy(float) - pdf[[f"{p}0" for p in _P]].to_numpy(float) for n in (1, 2, 3)], 2)
    six = np.linalg.det(edges) if len(pdf) else np.zeros(0)
    out = pdf[["tid"]].copy()
    inverse = np.zeros((len(pdf), 3, 3))
    inverse[six != 0] = np.linalg.inv(edges[six != 0])
    for r in range(3):
        for c in range(3):
            out[f"m{r}{c}"] = inverse[:, r, c]
    out["six_volumes"] = six
    return out
