"""Registered queries of operators whose results have a closed form or a short recursion in SQL:
exact fields (rotation, uniform, pulsating, linear), lattices and customer lines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .field import FlowField
from .functions import linalg
from .operators import aggregate, amr, blocks, derive, isosurface, lines, locate, mesh, seeding, transform
from .plans import fronts, rounds, tracing
from .queries import _BLOCKS, _COUNTS, _DIMS, _EVENTS, _FIELD, _JAC, _LOCATED, _POINTS, _blocks, _fixed, _linear_rk, _rotation_seeds, customer_points, events_field, lineitem_field, query, r6, rotation_field
from .queries_io import customer_lines
from .schema import Direction, Integration, Order
from .sql import register_streamlines

RK4 = Integration(order=Order.FOURTH)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))


def _mod(n: int, scale: int = 1, column: str = "id") -> Column:
    return F.pmod(F.col(column) * scale, F.lit(n)).cast("double")


# --- fields and sampling ---------------------------------------------------------------


@query(_FIELD + ", n AS (SELECT *, sqrt(u * u + v * v + w * w) AS m FROM f) SELECT t, i, j, k, " + ", ".join(f"round(CASE WHEN m = 0 THEN {c} ELSE {c} / m END, 6) + 0e0 AS {c}" for c in "uvw") + " FROM n")
def normalize_twice(spark, sf_dir):
    return transform.normalize_global(transform.normalize_local(lineitem_field(spark, sf_dir))).nodes.select("t", "i", "j", "k", r6("u"), r6("v"), r6("w"))


@query(_FIELD + " SELECT t, i, j, k, u, v, u + 2e0 * v AS w FROM f")
def scan_callback(spark, sf_dir):
    return transform.scan_field(lineitem_field(spark, sf_dir), lambda p: p.assign(w=p.u + 2 * p.v)).nodes.select("t", "i", "j", "k", "u", "v", "w")


@query(_FIELD + " SELECT t, i, j, k, u, v, w, 'outflow' AS kind FROM f WHERE j = 5 AND v < 0 UNION ALL SELECT t, i, j, k, u, v, w, 'tangential' FROM f WHERE k = 2 AND w = 0 UNION ALL SELECT t, i, j, k, u, v, w, 'inflow' FROM f WHERE i = 0 AND u > 0")
def slice_regions(spark, sf_dir):
    from .schema import Axis

    field = lineitem_field(spark, sf_dir)
    parts = [transform.slice_region(field, a, n, kind).select("t", "i", "j", "k", "u", "v", "w", F.lit(kind).alias("kind")) for a, n, kind in ((Axis.Y, 5, "outflow"), (Axis.Z, 2, "tangential"), (Axis.X, 0, "inflow"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH c AS (SELECT c_custkey AS id, CAST(c_custkey % 7 AS DOUBLE) AS a, CAST(c_custkey % 11 AS DOUBLE) AS b, CAST(c_custkey % 13 AS DOUBLE) AS d, CAST(c_custkey % 17 AS DOUBLE) AS e, CAST(c_custkey % 10 AS DOUBLE) / 10e0 AS s, CAST(c_custkey % 8 AS DOUBLE) / 8e0 AS r FROM customer)
SELECT id, round(a * (1e0 - s) + b * s, 9) + 0e0 AS linear, round((a * (1e0 - s) + b * s) * (1e0 - r) + (d * (1e0 - s) + e * s) * r, 9) + 0e0 AS bilinear FROM c""")
def linear_blends(spark, sf_dir):
    c = _customers(spark, sf_dir).select("id", *(_mod(n).alias(x) for n, x in ((7, "a"), (11, "b"), (13, "d"), (17, "e"))), (_mod(10) / 10.0).alias("s"), (_mod(8) / 8.0).alias("r"))
    v = tuple(F.col(x) for x in "abde")
    return c.select("id", (F.round(locate.lerp(v[0], v[1], F.col("s")), 9) + F.lit(0.0)).alias("linear"), (F.round(locate.bilerp(v, F.col("s"), F.col("r")), 9) + F.lit(0.0)).alias("bilinear"))


@query(_EVENTS + """, q AS (SELECT c_custkey AS id, CAST(c_custkey % 12 AS INTEGER) AS t, CAST(c_custkey % 6 AS INTEGER) AS i, CAST(c_custkey // 6 % 5 AS INTEGER) AS j, CAST(c_custkey // 30 % 5 AS INTEGER) AS k FROM customer)
SELECT id, t, i, j, k, u, v, w FROM q LEFT JOIN f USING (t, i, j, k)""")
def values_at_nodes(spark, sf_dir):
    n = F.col("id")
    keys = _customers(spark, sf_dir).select("id", F.pmod(n, F.lit(12)).cast("int").alias("t"), F.pmod(n, F.lit(6)).cast("int").alias("i"), (F.floor(n / 6) % 5).cast("int").alias("j"), (F.floor(n / 30) % 5).cast("int").alias("k"))
    return locate.node_values(keys, events_field(spark, sf_dir)).select("id", "t", "i", "j", "k", "u", "v", "w")


@query(_LOCATED + """ SELECT point_id, CAST(n AS INTEGER) AS corner, u, v, w FROM (SELECT point_id, n, ci + n % 2 AS i, cj + (n // 2) % 2 AS j, ck + n // 4 AS k FROM c, range(8) r(n) WHERE ci IS NOT NULL) JOIN f USING (i, j, k)""")
def values_at_cells(spark, sf_dir):
    field = lineitem_field(spark, sf_dir)
    cells = locate.locate_cells(customer_points(spark, sf_dir), field).where("cell >= 0").withColumn("t", F.lit(0)).select("point_id", "t", "ci", "cj", "ck")
    return locate.cell_values(cells, field).select("point_id", "corner", "u", "v", "w")


def _sampled(source: str, keys: str, name: str) -> str:
    """CTE ``name`` (keys, u, v, w): the lineitem field at the points (keys, x, y, z) of ``source``."""
    return f"""{name}_c AS (SELECT {keys}, x, y, z, CAST(least(floor(x), 10) AS INTEGER) AS ci, CAST(least(floor(y), 10) AS INTEGER) AS cj, CAST(least(floor(z), 5) AS INTEGER) AS ck
  FROM {source} WHERE x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 11 AND z BETWEEN 0 AND 6
), {name}_w AS (SELECT {keys}, ci + o % 2 AS i, cj + (o // 2) % 2 AS j, ck + o // 4 AS k,
  (CASE WHEN o % 2 = 1 THEN x - ci ELSE 1 - (x - ci) END) * (CASE WHEN (o // 2) % 2 = 1 THEN y - cj ELSE 1 - (y - cj) END) * (CASE WHEN o // 4 = 1 THEN z - ck ELSE 1 - (z - ck) END) AS weight
  FROM {name}_c, range(8) r(o)
), {name} AS (SELECT {keys}, sum(weight * u) AS u, sum(weight * v) AS v, sum(weight * w) AS w FROM {name}_w JOIN f USING (i, j, k) GROUP BY ALL)"""


_TWICE = "(SELECT point_id, x, y, z FROM p UNION ALL SELECT point_id, x, y, z FROM p WHERE point_id % 3 = 0 UNION ALL SELECT CAST(NULL AS BIGINT), y, x, z FROM p WHERE point_id % 5 = 0)"


def _repeated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer points, a third of them twice, and points without an id."""
    p = customer_points(spark, sf_dir)
    return p.unionByName(p.where("point_id % 3 = 0")).unionByName(p.where("point_id % 5 = 0").select(F.lit(None).cast("long").alias("point_id"), F.col("y").alias("x"), F.col("x").alias("y"), "z"))


@query(_FIELD + ", " + _POINTS + f", q AS {_TWICE}, d AS (SELECT DISTINCT x, y, z FROM q), " + _sampled("d", "x, y, z", "m").replace("SELECT x, y, z, x, y, z,", "SELECT x, y, z,") .replace("m_w AS (SELECT x, y, z, ci", "m_w AS (SELECT x, y, z, ci")
       + " SELECT q.point_id, q.x, q.y, q.z, round(u, 6) + 0e0 AS u, round(v, 6) + 0e0 AS v, round(w, 6) + 0e0 AS w FROM q LEFT JOIN m USING (x, y, z)")
def sample_repeated_points(spark, sf_dir):
    return locate.sample(_repeated_points(spark, sf_dir), lineitem_field(spark, sf_dir)).select("point_id", "x", "y", "z", r6("u"), r6("v"), r6("w"))


_PROBES = "probes(n, dx, dy, dz) AS (VALUES (0, 0e0, 0e0, 0e0), (1, -0.1e0, 0e0, 0e0), (2, 0.1e0, 0e0, 0e0), (3, 0e0, -0.1e0, 0e0), (4, 0e0, 0.1e0, 0e0), (5, 0e0, 0e0, -0.1e0), (6, 0e0, 0e0, 0.1e0))"


def _jacobian_sql() -> str:
    wide = ", ".join(f"max(CASE WHEN n = {n} THEN {c} END) AS {c}{n}" for n in range(7) for c in "uvw")
    out = []
    for r, c in enumerate("uvw"):
        for a in range(3):
            b, f = f"{c}{1 + 2 * a}", f"{c}{2 + 2 * a}"
            out.append(f"round(CASE WHEN {c}0 IS NULL THEN NULL WHEN {b} IS NOT NULL AND {f} IS NOT NULL THEN ({f} - {b}) / 0.2e0 WHEN {f} IS NOT NULL THEN ({f} - {c}0) / 0.1e0 WHEN {b} IS NOT NULL THEN ({c}0 - {b}) / 0.1e0 END, 6) + 0e0 AS j{r}{a}")
    return (f"{_FIELD}, {_POINTS}, {_PROBES}, q AS (SELECT point_id, n, x + dx AS x, y + dy AS y, z + dz AS z FROM p, probes), {_sampled('q', 'point_id, n', 'm')}, "
            f"pr AS (SELECT point_id, {wide} FROM m GROUP BY 1) SELECT point_id, {', '.join(out)} FROM p LEFT JOIN pr USING (point_id)")  # fmt: skip


@query(_jacobian_sql())
def jacobian_at_points(spark, sf_dir):
    got = derive.jacobian_at(customer_points(spark, sf_dir), lineitem_field(spark, sf_dir))
    return got.select("point_id", *(r6(f"j{r}{c}") for r in range(3) for c in range(3)))


def _curl_sql() -> str:
    arms = []
    for a, p in enumerate("xyz"):
        for side, at in enumerate((f"CASE WHEN floor({p}) = {p} THEN {p} - 1 ELSE floor({p}) END", f"CASE WHEN floor({p}) = {p} THEN {p} + 1 ELSE ceil({p}) END")):
            arms.append(f"SELECT point_id, {2 * a + side} AS n, " + ", ".join(f"{at if q == p else q} AS {q}" for q in "xyz") + " FROM p")
    wide = ", ".join(f"max(CASE WHEN n = {n} THEN {c} END) AS {c}{n}" for n in range(6) for c in "uvw")
    ends = ", ".join(f"max(CASE WHEN n = {n} THEN {'xyz'[n // 2]} END) AS e{n}" for n in range(6))
    d = lambda c, a: f"(({c}{2 * a + 1} - {c}{2 * a}) / (e{2 * a + 1} - e{2 * a}))"
    curl = (f"{d('w', 1)} - {d('v', 2)}", f"{d('u', 2)} - {d('w', 0)}", f"{d('v', 0)} - {d('u', 1)}")
    return (f"{_FIELD}, {_POINTS}, q AS ({' UNION ALL '.join(arms)}), {_sampled('q', 'point_id, n', 'm')}, pr AS (SELECT point_id, {wide}, {ends} FROM q LEFT JOIN m USING (point_id, n) GROUP BY 1) "
            "SELECT point_id, " + ", ".join(f"round({c}, 6) + 0e0 AS curl_{p}" for c, p in zip(curl, "xyz", strict=True)) + " FROM p LEFT JOIN pr USING (point_id)")  # fmt: skip


@query(_curl_sql())
def curl_at_points(spark, sf_dir):
    return derive.curl_at(customer_points(spark, sf_dir), lineitem_field(spark, sf_dir)).select("point_id", r6("curl_x"), r6("curl_y"), r6("curl_z"))


_SCALED = (2.0, 4.0, 0.5)


@query(_JAC + " SELECT t, i, j, k, " + ", ".join(f"round(j{r}{c} / {s}e0, 6) + 0e0 AS j{r}{c}" for r in range(3) for c, s in enumerate(_SCALED)) + " FROM jac")
def jacobian_curvilinear(spark, sf_dir):
    field = lineitem_field(spark, sf_dir)
    vertices = field.nodes.select("i", "j", "k", *((F.col(c) * s).alias(p) for c, p, s in zip("ijk", "xyz", _SCALED, strict=True)))
    return derive.jacobian_curvilinear(field, vertices).select("t", "i", "j", "k", *(r6(f"j{r}{c}") for r in range(3) for c in range(3)))


def _eigen_sql(m: str, source: str, name: str) -> str:
    """CTE ``name``: ``source`` with the eigenvalues m_1 >= m_2 >= m_3 of the symmetric m00, m01, m02, m11, m12, m22."""
    return f"""{name}_q AS (SELECT *, ({m}00 + {m}11 + {m}22) / 3e0 AS {m}_q, {m}01 * {m}01 + {m}02 * {m}02 + {m}12 * {m}12 AS {m}_off FROM {source}),
{name}_p AS (SELECT *, sqrt((({m}00 - {m}_q) * ({m}00 - {m}_q) + ({m}11 - {m}_q) * ({m}11 - {m}_q) + ({m}22 - {m}_q) * ({m}22 - {m}_q) + 2e0 * {m}_off) / 6e0) AS {m}_p,
 ({m}00 - {m}_q) * (({m}11 - {m}_q) * ({m}22 - {m}_q) - {m}12 * {m}12) + {m}01 * ({m}12 * {m}02 - {m}01 * ({m}22 - {m}_q)) + {m}02 * ({m}01 * {m}12 - ({m}11 - {m}_q) * {m}02) AS {m}_det FROM {name}_q),
{name}_f AS (SELECT *, acos(greatest(-1e0, least(1e0, CASE WHEN {m}_p = 0 THEN 0e0 ELSE {m}_det / (2e0 * {m}_p * {m}_p * {m}_p) END))) / 3e0 AS {m}_phi FROM {name}_p),
{name} AS (SELECT *, {m}_q + 2e0 * {m}_p * cos({m}_phi) AS {m}_1, {m}_q + 2e0 * {m}_p * cos({m}_phi + 2.0943951023931953e0) AS {m}_3, 3e0 * {m}_q - ({m}_q + 2e0 * {m}_p * cos({m}_phi)) - ({m}_q + 2e0 * {m}_p * cos({m}_phi + 2.0943951023931953e0)) AS {m}_2 FROM {name}_f)"""


def _metrics_sql() -> str:
    s = lambda a, b: f"(j{a}{b} + j{b}{a}) * 0.5e0"
    r = lambda a, b: f"(j{a}{b} - j{b}{a}) * 0.5e0"
    parts = ", ".join([f"{s(a, b)} AS s{a}{b}" for a in range(3) for b in range(3)] + [f"{r(a, b)} AS r{a}{b}" for a in range(3) for b in range(3)])
    dot = lambda x, a, b: "(" + " + ".join(f"{x}{a}{k} * {x}{k}{b}" for k in range(3)) + ")"
    m = ", ".join(f"{dot('s', a, b)} + {dot('r', a, b)} AS m{a}{b}" for a in range(3) for b in range(a, 3))
    return (f"{_JAC}, sr AS (SELECT *, {parts} FROM jac), mm AS (SELECT *, {m} FROM sr), {_eigen_sql('m', 'mm', 'em')}, {_eigen_sql('s', 'em', 'es')} "
            "SELECT t, i, j, k, round(m_2, 4) + 0e0 AS lambda2, round(CASE WHEN abs(s_1) > 1e-12 THEN abs(sqrt(r01 * r01 + r02 * r02 + r12 * r12) / s_1) END, 4) + 0e0 AS gamma2 FROM es")  # fmt: skip


@query(_metrics_sql())
def lambda2_gamma2(spark, sf_dir):
    got = derive.vortex_metrics(derive.jacobian_nodes(lineitem_field(spark, sf_dir)))
    return got.select("t", "i", "j", "k", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("lambda2", "gamma2")))


_EIGEN = "WITH c AS (SELECT c_custkey AS id, CAST(c_custkey % 7 AS DOUBLE) - 3e0 AS a, CAST(c_custkey % 3 AS DOUBLE) AS b, CAST(c_custkey % 5 AS DOUBLE) - 2.5e0 AS c FROM customer)"


def _matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[[a, -b, 0], [b, a, 0], [0, 0, c]]: eigenvalues a + ib, a - ib and c."""
    a, b, c, z = _mod(7) - 3.0, _mod(3), _mod(5) - 2.5, F.lit(0.0)
    return _customers(spark, sf_dir).select("id", *(x.alias(f"j{n // 3}{n % 3}") for n, x in enumerate((a, -b, z, b, a, z, z, z, c))))


@query(_EIGEN + """ SELECT id, round(greatest(a, c), 6) + 0e0 AS re0, CASE WHEN c > a THEN round(a, 6) + 0e0 ELSE round(a, 6) + 0e0 END AS re1, round(least(a, c), 6) + 0e0 AS re2,
CASE WHEN c > a THEN 0e0 ELSE b END AS im0, CASE WHEN c > a THEN b ELSE -b END + 0e0 AS im1, CASE WHEN c > a THEN -b ELSE 0e0 END + 0e0 AS im2, CAST(CASE WHEN b = 0 THEN 3 ELSE 1 END AS INTEGER) AS n_real FROM c""")
def eigenvalues(spark, sf_dir):
    e = derive.eigen_table(_matrices(spark, sf_dir))
    return e.select("id", *(r6(c) for c in ("re0", "re1", "re2", "im0", "im1", "im2")), "n_real")


@query(_EIGEN + " SELECT id, true AS settled FROM c")
def eigenvectors(spark, sf_dir):
    """A v = lambda v for all three vectors, and each has length 1."""
    e = derive.eigen_table(_matrices(spark, sf_dir))
    ok = F.lit(True)
    for n in range(3):
        re, im = F.col("vectors_re")[n], F.col("vectors_im")[n]
        size = sum((re[c] * re[c] + im[c] * im[c] for c in range(3)), F.lit(0.0))
        ok = ok & (F.abs(size - 1) < 1e-9)
        for r in range(3):
            left = sum((F.col(f"j{r}{c}") * re[c] for c in range(3)), F.lit(0.0)) - (F.col(f"re{n}") * re[r] - F.col(f"im{n}") * im[r])
            other = sum((F.col(f"j{r}{c}") * im[c] for c in range(3)), F.lit(0.0)) - (F.col(f"re{n}") * im[r] + F.col(f"im{n}") * re[r])
            ok = ok & (F.abs(left) < 1e-9) & (F.abs(other) < 1e-9)
    return e.select("id", ok.alias("settled"))


@query(_EIGEN + """, k AS (SELECT *, CASE WHEN a >= 0 THEN 2 ELSE 0 END + CASE WHEN c >= 0 THEN 1 ELSE 0 END AS n FROM c)
SELECT id, CASE WHEN abs((a * a + b * b) * c) < 1e-12 THEN 'degenerate' ELSE CASE n WHEN 3 THEN 'repelling' WHEN 0 THEN 'attracting' WHEN 2 THEN 'repelling_saddle' ELSE 'attracting_saddle' END || CASE WHEN b = 0 THEN '_node' ELSE '_spiral' END END AS kind FROM k""")
def critical_kinds_by_matrix(spark, sf_dir):
    return derive.classify_critical_points(_matrices(spark, sf_dir)).select("id", "kind")


def _linear(spark: SparkSession, n: int, f) -> FlowField:
    k, j, i = np.indices((n, n, n)).astype(float)
    return FlowField.from_numpy(spark, np.stack(f(i, j, k), -1))


@query("SELECT 0 AS t, 2.3e0 AS x, 1.25e0 AS y, 3.4e0 AS z, 'attracting_saddle_node' AS kind")
def critical_point_of_a_saddle(spark, sf_dir):
    field = _linear(spark, 6, lambda i, j, k: (i - 2.3, 2 * (1.25 - j), 3 * (3.4 - k)))
    return derive.classify_critical_points(isosurface.critical_points(field)).select("t", r6("x"), r6("y"), r6("z"), "kind")


@query("SELECT CAST(n AS INTEGER) AS t, 2.5e0 AS iso, 25e0 AS area, 2.5e0 - n AS x FROM range(3) r(n)")
def iso_surface_of_a_series(spark, sf_dir):
    """u = i + t: the surface u = 2.5 is a plane that moves one cell a step."""
    k, j, i = np.indices((6, 6, 6)).astype(float)
    field = FlowField.from_numpy(spark, np.stack([np.stack([i + t, j, k], -1) for t in range(3)]))
    tri = isosurface.iso_surface(field, "u", [2.5])
    p = [linalg.vec(f"x{n}", f"y{n}", f"z{n}") for n in range(3)]
    area = linalg.norm(linalg.cross(linalg.sub(p[1], p[0]), linalg.sub(p[2], p[0]))) / 2.0
    return tri.groupBy("t", "iso").agg((F.round(F.sum(area), 6) + F.lit(0.0)).alias("area"), (F.round(F.avg(F.col("x0")), 6) + F.lit(0.0)).alias("x"))


@query("WITH RECURSIVE " + _linear_rk("rk4").removeprefix("WITH RECURSIVE ").replace(" SELECT seed_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM s", "") + " SELECT seed_id, seq, 0.04e0 AS q, -0.04e0 AS lambda2, CASE WHEN x = 8 AND y = 8 THEN 0e0 ELSE 0.2e0 END AS curvature FROM s")
def rotation_line_metrics(spark, sf_dir):
    field = rotation_field(spark)
    points = tracing.streamlines(field, _rotation_seeds(spark), Direction.FORWARD, RK4.fixed(0.25), 25)
    return derive.trace_metrics(points.drop("status"), field).select("seed_id", "seq", r6("q"), r6("lambda2"), r6("curvature"))


@query("""WITH c AS (SELECT c_custkey AS id, CAST(c_custkey % 5 AS DOUBLE) + 1e0 AS a, CAST(c_custkey % 3 AS DOUBLE) AS b, CAST(c_custkey % 7 AS DOUBLE) - 8e0 AS d FROM customer)
SELECT id, round(a * a * d, 6) + 0e0 AS det, round(1e0 / a, 6) + 0e0 AS i00, round(-b / (a * a), 6) + 0e0 AS i01, round(1e0 / d, 6) + 0e0 AS i22, round(a * 1e0 + b * 2e0, 6) + 0e0 AS x, round(a * a * d * 2e0, 6) + 0e0 AS det4, round(0.5e0, 6) AS i33, round(-b, 6) + 0e0 AS turned FROM c""")
def matrix_functions(spark, sf_dir):
    """[[a, b, 0], [0, a, 0], [0, 0, d]], and the same with a fourth row (0, 0, 0, 2)."""
    c = _customers(spark, sf_dir).select("id", (_mod(5) + 1.0).alias("a"), _mod(3).alias("b"), (_mod(7) - 8.0).alias("d"))
    a, b, d, z = F.col("a"), F.col("b"), F.col("d"), F.lit(0.0)
    m = ((a, b, z), (z, a, z), (z, z, d))
    four = ((a, b, z, z), (z, a, z, z), (z, z, d, z), (z, z, z, F.lit(2.0)))
    inverse = linalg.inv3(m)
    turned = linalg.matmul(linalg.rotation("z", 90.0), (*((*r, z) for r in m), (z, z, z, F.lit(1.0))))
    out = {"det": linalg.det3(m), "i00": inverse[0][0], "i01": inverse[0][1], "i22": inverse[2][2], "x": linalg.matvec(m, (F.lit(1.0), F.lit(2.0), z))[0], "det4": linalg.det4(four), "i33": linalg.inv4(four)[3][3]}
    got = c.select("id", *((F.round(x, 6) + F.lit(0.0)).alias(n) for n, x in out.items()), (F.round(-turned[1][1], 6) + F.lit(0.0)).alias("turned"))
    return got


# --- aggregation and order ------------------------------------------------------------------


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, sf_dir):
    return aggregate.distinct_sorted(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority")


@query("SELECT 0 AS gid, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer")
def radix_merge(spark, sf_dir):
    rows = _customers(spark, sf_dir).select((F.col("id") % 27).alias("gid"), "id").groupBy("gid").agg(F.count("*").alias("n"), F.sum("id").alias("total"))
    return aggregate.merge_blocks(rows, "gid", lambda p: p[["n", "total"]].sum().to_frame().T, "gid long, n long, total long", 3).withColumn("gid", F.col("gid").cast("int"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def order_rank(spark, sf_dir):
    return aggregate.global_rank(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey").select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT CAST(id AS INTEGER) AS leaf, true AS even FROM range(8) r(id)")
def kd_leaves(spark, sf_dir):
    """Eight leaves with about an eighth of the orders each, and every order is found in its leaf."""
    n = F.col("o_orderkey")
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.xxhash64(n, F.lit(1)) / 2.0**63).alias("x"), (F.xxhash64(n, F.lit(2)) / 2.0**63).alias("y"), (F.xxhash64(n, F.lit(3)) / 2.0**63).alias("z"))
    out, _ = aggregate.kd_tree(p, 3)
    total = p.count() / 8
    return out.groupBy("leaf").agg((F.abs(F.count("*") - F.lit(total)) <= F.lit(total * 0.05 + 2)).alias("even"))


@query("SELECT CAST(c_custkey % 5 AS INTEGER) AS block, CAST(0 AS DOUBLE) AS far, count(*) AS n FROM customer GROUP BY 1")
def block_extents(spark, sf_dir):
    c = _customers(spark, sf_dir).select(F.pmod("id", F.lit(5)).cast("int").alias("block"), _mod(5).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))
    n = c.groupBy("block").agg(F.count("*").alias("n"))
    return aggregate.bounding_box(c, "block").select("block", (F.col("xmax") - F.col("xmin")).alias("far")).join(n, "block")


# --- seeds ------------------------------------------------------------------------------------


def _generator_sql(n: int) -> str:
    """The C library's additive feedback generator by recursion, and seeds in single precision."""
    start = ["1"]
    f = lambda x: f"CAST({x} AS FLOAT)"
    del start
    return f"""WITH RECURSIVE a(i, v) AS (SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, (16807 * v) % 2147483647 FROM a WHERE i < 30),
r(i, s) AS (SELECT 34, list_concat(l, l[1:3]) FROM (SELECT list(v ORDER BY i) AS l FROM a) UNION ALL SELECT i + 1, list_append(s, (s[i - 30] + s[i - 2]) % 4294967296) FROM r WHERE i < {344 + 3 * n}),
o AS (SELECT unnest(range({3 * n})) AS k, unnest(s[345:{344 + 3 * n}]) // 2 AS v FROM r WHERE i = {344 + 3 * n}),
d AS (SELECT k // 3 AS seed_id, k % 3 AS axis, {f('v')} / {f('2147483647')} AS a FROM o)
SELECT seed_id, """ + ", ".join(f"round(CAST(max(CASE WHEN axis = {k} THEN ({f('1')} - a) * {f('0')} + a * {f('47')} END) AS DOUBLE), 4) AS {p}" for k, p in enumerate("xyz")) + " FROM d GROUP BY 1"


@query(_generator_sql(40))
def compatible_seeds(spark, sf_dir):
    return seeding.compatible_seeds(spark, (0, 0, 0), (47, 47, 47), 40).select("seed_id", *(F.round(p, 4).alias(p) for p in "xyz"))


@query("SELECT 3 AS dim, 500 AS n, 500 AS places, true AS inside UNION ALL SELECT 2, 500, 500, true UNION ALL SELECT 1, 500, 500, true UNION ALL SELECT 0, 500, 1, true")
def random_rakes(spark, sf_dir):
    out = None
    for hi in ((11, 11, 6), (11, 11, 1), (11, 1, 1), (1, 1, 1)):
        s = seeding.random_seeds(spark, (1, 1, 1), hi, 500, 7)
        row = s.agg(F.lit(seeding.rake_dimension((1, 1, 1), hi)).alias("dim"), F.count("*").cast("int").alias("n"), F.countDistinct("x", "y", "z").cast("int").alias("places"), F.min(transform.in_box((1, 1, 1), hi)).alias("inside"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 2000 AS n, true AS known, true AS many")
def resampled_seeds(spark, sf_dir):
    """2,000 draws with replacement from the customers' points: all of them are points of the set."""
    p = customer_points(spark, sf_dir).select("x", "y", "z")
    got = seeding.resample(p, 2000, 5)
    known = got.join(p.distinct().withColumn("known", F.lit(True)), ["x", "y", "z"], "left")
    return known.agg(F.count("*").cast("int").alias("n"), F.min(F.coalesce("known", F.lit(False))).alias("known"), (F.countDistinct("x", "y", "z") > 60).alias("many"))


@query("WITH " + _POINTS + " SELECT point_id AS seed_id, x, y, z, CAST(point_id % 10 AS DOUBLE) AS t FROM p")
def seeds_with_times(spark, sf_dir):
    return seeding.with_times(customer_points(spark, sf_dir).withColumnRenamed("point_id", "seed_id"), _mod(10, column="seed_id"))


@query(_BLOCKS + " SELECT gid, 5 AS n, true AS inside FROM b WHERE real_lo_t = 0")
def seeds_in_blocks(spark, sf_dir):
    b = _blocks(spark)
    got = seeding.block_seeds(b, 5, 3).join(b.select(F.col("gid").alias("block"), *(f"real_{s}_{p}" for s in ("lo", "hi") for p in "xyz")), "block")
    ok = F.lit(True)
    for p in "xyz":
        ok = ok & F.col(p).between(F.col(f"real_lo_{p}"), F.col(f"real_hi_{p}"))
    return got.groupBy(F.col("block").alias("gid")).agg(F.count("*").cast("int").alias("n"), F.min(ok).alias("inside"))


@query(_BLOCKS + ", s AS (SELECT gid * 5 + n AS seed_id FROM b, range(5) r(n) WHERE real_lo_t = 0) SELECT seed_id, true AS placed FROM s")
def curvilinear_seeds_in_blocks(spark, sf_dir):
    """Index-space seeds, placed on the grid x = 2 i, y = j + i / 2, z = k."""
    field = lineitem_field(spark, sf_dir)
    vertices = field.nodes.select("i", "j", "k", (F.col("i") * 2.0).alias("x"), (F.col("j") + F.col("i") / 2.0).alias("y"), F.col("k").cast("double").alias("z"))
    got = seeding.curvilinear_block_seeds(_blocks(spark), vertices, field.dims, 5, 3)
    ok = (F.abs(F.col("x") - 2 * F.col("ci")) < 1e-9) & (F.abs(F.col("y") - F.col("cj") - F.col("ci") / 2) < 1e-9) & (F.abs(F.col("z") - F.col("ck")) < 1e-9)
    return got.select("seed_id", ok.alias("placed"))


@query("SELECT id AS seed_id, CASE WHEN id = 22 THEN 'CRITICAL' WHEN id > 44 THEN 'OUT_OF_BOUND' ELSE 'MAX_POINTS' END AS status, CAST(CASE WHEN id = 22 OR id > 44 THEN 0 ELSE 5 END AS BIGINT) AS n_points FROM range(50) r(id)")
def seed_status(spark, sf_dir):
    """Seeds along the middle line of the rotation: one at its centre, some outside."""
    seeds = spark.range(50).select(F.col("id").alias("seed_id"), (F.col("id") * 0.35 + 0.3).alias("x"), F.lit(8.0).alias("y"), F.lit(2.0).alias("z"))
    got = tracing.streamlines(rotation_field(spark), seeds, Direction.FORWARD, RK4.fixed(0.01), 5, emit_empty=True)
    return got.groupBy("seed_id", "status").agg(F.count("seq").alias("n_points"))


# --- integration and lines -----------------------------------------------------------------------


def _stages(order: str, f, h: str, x: str = "x", y: str = "y") -> str:
    """Nested selects that add the stages k1x, k1y, ... of a step of length ``h`` to the rows of ``{source}``; ends with new x and y (nx, ny)."""
    tables = {"rk4": ([[], [0.5], [0, 0.5], [0, 0, 1]], [1 / 6, 2 / 6, 2 / 6, 1 / 6]),
              "rk45": ([[], [1 / 5], [3 / 40, 9 / 40], [3 / 10, -9 / 10, 6 / 5], [-11 / 54, 5 / 2, -70 / 27, 35 / 27], [1631 / 55296, 175 / 512, 575 / 13824, 44275 / 110592, 253 / 4096]],
                       [37 / 378, 0.0, 250 / 621, 125 / 594, 0.0, 512 / 1771])}
    stages, weights = tables[order]
    out = "{source}"
    term = lambda c, ws: "".join(f" + ({w!r}e0) * k{n + 1}{c}" if "e" not in repr(w) else f" + ({w!r}) * k{n + 1}{c}" for n, w in enumerate(ws) if w)
    for n, ws in enumerate(stages, 1):
        px, py = f"({x}{term('x', ws)})", f"({y}{term('y', ws)})"
        u, v = f(px, py)
        out = f"(SELECT *, ({h}) * ({u}) AS k{n}x, ({h}) * ({v}) AS k{n}y FROM {out})"
    return f"(SELECT *, {x}{term('x', weights)} AS nx, {y}{term('y', weights)} AS ny FROM {out})"


_ROTATE = lambda x, y: (f"-0.2e0 * ({y} - 8e0)", f"0.2e0 * ({x} - 8e0)")
_UNIT = lambda x, y: (f"-({y} - 8e0) / sqrt(({x} - 8e0) * ({x} - 8e0) + ({y} - 8e0) * ({y} - 8e0))", f"({x} - 8e0) / sqrt(({x} - 8e0) * ({x} - 8e0) + ({y} - 8e0) * ({y} - 8e0))")
_SEED_ROWS = "(SELECT id AS seed_id, 9e0 + CAST(id AS DOUBLE) / 7e0 AS x, 8e0 AS y FROM range(40) r(id))"


def _recursion(step: str, n: int, extra: str = "") -> str:
    body = step.replace("{source}", f"(SELECT seed_id, seq, x, y FROM s WHERE seq < {n}{extra})")
    return f"WITH RECURSIVE s AS (SELECT seed_id, 0 AS seq, x, y FROM {_SEED_ROWS} UNION ALL SELECT seed_id, seq + 1, nx, ny FROM {body})"


@query(_recursion(_stages("rk4", _UNIT, "0.25e0"), 24) + " SELECT seed_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM s")
def normalised_after_sampling(spark, sf_dir):
    got = tracing.streamlines(rotation_field(spark), _rotation_seeds(spark), Direction.FORWARD, RK4.fixed(0.25), 25, normalize=True)
    return got.select("seed_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_recursion(_stages("rk45", _ROTATE, "0.25e0"), 24) + " SELECT seed_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM s")
def rk45_fixed(spark, sf_dir):
    return _fixed(spark, Order.RK45)


def _one_step(order: str, digits: int) -> str:
    return f"SELECT seed_id, round(nx, {digits}) AS x, round(ny, {digits}) AS y, 0.5e0 AS t, 'OKAY' AS status FROM {_stages(order, _ROTATE, '0.5e0').replace('{source}', _SEED_ROWS)}"


def _advected(spark: SparkSession, order: Order, digits: int) -> DataFrame:
    got = tracing.advect_once(rotation_field(spark), _rotation_seeds(spark).withColumn("t", F.lit(0.0)), 0.5, order)
    return got.select("seed_id", F.round("x", digits).alias("x"), F.round("y", digits).alias("y"), "t", "status")


@query(_one_step("rk4", 7))
def advect_once_rk4(spark, sf_dir):
    return _advected(spark, Order.FOURTH, 7)


@query(_one_step("rk45", 6))
def advect_once_rk45(spark, sf_dir):
    return _advected(spark, Order.RK45, 6)


@query("SELECT id AS seed_id, CASE WHEN id % 9 < 8 THEN id % 9 / 2e0 + 0.5e0 ELSE 4e0 END AS x, CASE WHEN id % 9 < 8 THEN 'OKAY' ELSE 'FAIL' END AS status, CASE WHEN id % 9 < 8 THEN 0.5e0 ELSE 0e0 END AS t FROM range(90) r(id)")
def stage_outside_fails(spark, sf_dir):
    """u = 1 on a box of side 4: a stage beyond the face fails the step and the place stays."""
    field = _linear(spark, 5, lambda i, j, k: (i * 0 + 1, j * 0, k * 0))
    seeds = spark.range(90).select(F.col("id").alias("seed_id"), (_mod(9) / 2.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"), F.lit(0.0).alias("t"))
    return tracing.advect_once(field, seeds, 0.5, Order.FOURTH).select("seed_id", "x", "status", "t")


@query("SELECT id AS seed_id, 'MAX_POINTS' AS status, 60 AS n_points, true AS on_circle FROM range(40) r(id)")
def rk45_keeps_the_radius(spark, sf_dir):
    """Adaptive steps on the rotation: the distance from the centre stays within the error that is asked for."""
    got = tracing.streamlines(rotation_field(spark), _rotation_seeds(spark), Direction.FORWARD, Integration(max_error=1e-6, max_step=0.5), 60)
    far = F.sqrt((F.col("x") - 8) * (F.col("x") - 8) + (F.col("y") - 8) * (F.col("y") - 8)) - (1.0 + F.col("seed_id") / 7.0)
    return got.groupBy("seed_id", "status").agg(F.count("*").cast("int").alias("n_points"), (F.max(F.abs(far)) < 1e-3).alias("on_circle"))


@query("SELECT id AS seed_id, true AS in_order, true AS bounded FROM range(40) r(id)")
def angle_controlled_steps(spark, sf_dir):
    """Fourth-order steps by turning angle: from the third point on no accepted turn is above 15 degrees (steps above the least one)."""
    got = tracing.streamlines(rotation_field(spark), _rotation_seeds(spark), Direction.FORWARD, Integration(order=Order.FOURTH, max_step=2.0), 60).drop("status")
    t = lines.tangents(got)
    from pyspark.sql import Window

    w = Window.partitionBy("seed_id").orderBy("seq")
    turn = linalg.dot(linalg.vec("tx", "ty", "tz"), tuple(F.lead(c).over(w) for c in ("tx", "ty", "tz")))
    t = t.withColumns({"turn": turn, "gone": F.col("t") - F.lag("t").over(w)})
    return t.groupBy("seed_id").agg((F.min(F.coalesce("gone", F.lit(1.0))) > 0).alias("in_order"), (F.min(F.when(F.col("seq") >= 1, F.coalesce("turn", F.lit(1.0))).otherwise(F.lit(1.0))) >= math.cos(math.radians(15.001))).alias("bounded"))


@query("SELECT * FROM (VALUES ('default', 1e0, 0.01e0, 5e0, 0.01e0, 3e0, 15e0, true), ('from_steps', 0.5e0, 0.0002e0, 2e0, 0.01e0, 3e0, 15e0, true), ('fixed', 0.25e0, 0.01e0, 5e0, 0.01e0, 3e0, 15e0, false)) v(name, step, min_step, max_step, max_error, low_angle, high_angle, adaptive)")
def integration_settings(spark, sf_dir):
    found = {"default": Integration(), "from_steps": Integration.from_steps(0.5, 2.0), "fixed": Integration().fixed(0.25)}
    rows = [(n, o.step, o.min_step, o.max_step, o.max_error, o.low_angle, o.high_angle, o.adaptive) for n, o in found.items()]
    return spark.createDataFrame(rows, "name string, step double, min_step double, max_step double, max_error double, low_angle double, high_angle double, adaptive boolean")


@query(_linear_rk("rk4"))
def streamline_table_function(spark, sf_dir):
    """The lines of ``rk4_fixed`` from SQL: a lateral join with a table function."""
    register_streamlines(spark, rotation_field(spark), "streamlines", RK4.fixed(0.25), 25)
    _rotation_seeds(spark).createOrReplaceTempView("rotation_seeds")
    return spark.sql("SELECT s.seed_id, l.seq, round(l.x, 6) AS x, round(l.y, 6) AS y FROM rotation_seeds s, LATERAL streamlines(s.x, s.y, s.z) l")


def _both(select: str) -> str:
    ahead, back = _stages("rk4", _ROTATE, "0.25e0"), _stages("rk4", _ROTATE, "-0.25e0")
    one = lambda name, step: f"{name} AS (SELECT seed_id, 0 AS seq, x, y FROM {_SEED_ROWS} UNION ALL SELECT seed_id, seq + 1, nx, ny FROM {step.replace('{source}', f'(SELECT seed_id, seq, x, y FROM {name} WHERE seq < 14)')})"
    return f"WITH RECURSIVE {one('a', ahead)}, {one('b', back)} {select}"


@query(_both("SELECT seed_id, 1 AS dir, seq, round(x, 6) AS x, round(y, 6) AS y FROM a UNION ALL SELECT seed_id, -1, seq, round(x, 6), round(y, 6) FROM b"))
def both_directions(spark, sf_dir):
    got = tracing.streamlines(rotation_field(spark), _rotation_seeds(spark), Direction.BOTH, RK4.fixed(0.25), 15)
    return got.select("seed_id", "dir", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_both("SELECT seed_id, CAST(14 + seq AS INTEGER) AS seq, round(x, 6) AS x, round(y, 6) AS y FROM a UNION ALL SELECT seed_id, CAST(14 - seq AS INTEGER), round(x, 6), round(y, 6) FROM b WHERE seq > 0"))
def merged_directions(spark, sf_dir):
    got = tracing.merge_directions(tracing.streamlines(rotation_field(spark), _rotation_seeds(spark), Direction.BOTH, RK4.fixed(0.25), 15))
    return got.select("seed_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT id AS seed_id, CAST(n AS INTEGER) AS seq, round(CASE WHEN 0.1e0 * id + 0.3e0 * n > 4e0 THEN 4e0 ELSE 0.1e0 * id + 0.3e0 * n END, 6) AS x, 'OUT_OF_BOUND' AS status FROM range(30) a(id), range(20) r(n) WHERE n = 0 OR 0.1e0 * id + 0.3e0 * (n - 1) < 4e0 - 1e-9")
def lines_to_the_boundary(spark, sf_dir):
    """u = 1 on a box of side 4: steps of 0.3 until the face, where the last point lies."""
    field = _linear(spark, 5, lambda i, j, k: (i * 0 + 1, j * 0, k * 0))
    seeds = spark.range(30).select(F.col("id").alias("seed_id"), (F.col("id") * 0.1).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))
    return tracing.infinite_lines(field, seeds, RK4.fixed(0.3)).select("seed_id", "seq", F.round("x", 6).alias("x"), "status")


@query("SELECT id AS seed_id, 'LOOP' AS status, true AS closed FROM range(5) r(id)")
def lines_that_close(spark, sf_dir):
    """Rotation in steps of a hundredth of a turn: lines end where they meet themselves."""
    seeds = spark.range(5).select(F.col("id").alias("seed_id"), (9.0 + F.col("id")).alias("x"), F.lit(8.0).alias("y"), F.lit(2.0).alias("z"))
    got = tracing.infinite_lines(rotation_field(spark), seeds, RK4.fixed(2 * math.pi / 0.2 / 100), tolerance=1e-3)
    return got.groupBy("seed_id", "status").agg((F.max("seq") == 100).alias("closed"))


def _pulse(spark: SparkSession) -> FlowField:
    """u = t + 1 on a box 40 long, four steps."""
    return FlowField.from_numpy(spark, np.stack([np.ones((3, 3, 40, 3)) * [t + 1.0, 0, 0] for t in range(4)]))


@query("SELECT id AS seed_id, CAST(n AS INTEGER) AS seq, round(1e0 + id % 7 + ((id % 4) * 0.25e0 + n * 0.25e0) * (1 + ((id % 4) * 0.25e0 + n * 0.25e0) / 2) - (id % 4) * 0.25e0 * (1 + (id % 4) * 0.125e0), 6) AS x, (id % 4) * 0.25e0 + n * 0.25e0 AS t FROM range(50) a(id), range(8) r(n)")
def pathlines_with_own_times(spark, sf_dir):
    seeds = spark.range(50).select(F.col("id").alias("seed_id"), (1.0 + _mod(7)).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"), (_mod(4) * 0.25).alias("t"))
    got = tracing.pathlines(_pulse(spark), seeds, options=RK4.fixed(0.25), max_points=8)
    return got.select("seed_id", "seq", F.round("x", 6).alias("x"), F.round("t", 6).alias("t"))


@query("SELECT id AS seed_id, CAST(n AS INTEGER) AS seq, round(1e0 + id % 7 + n * 0.25e0 * (1 + n * 0.125e0), 6) AS x FROM range(50) a(id), range(10) r(n)")
def pathlines_by_time_blocks(spark, sf_dir):
    """The same through blocks in space and time; fragments are stitched."""
    seeds = spark.range(50).select(F.col("id").alias("seed_id"), (1.0 + _mod(7)).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"), F.lit(0.0).alias("t"))
    got = rounds.stitch(rounds.trace_by_blocks(_pulse(spark), seeds, 4, RK4.fixed(0.25), 10, time_blocks=3))
    return got.select("seed_id", "seq", F.round("x", 6).alias("x"))


@query(_linear_rk("rk4"))
def streamlines_by_blocks(spark, sf_dir):
    got = rounds.stitch(rounds.trace_by_blocks(rotation_field(spark), _rotation_seeds(spark), 4, RK4.fixed(0.25), 25))
    return got.select("seed_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_HALF = _stages("rk4", _ROTATE, "0.5e0")


@query(f"SELECT seed_id, round(nx, 6) AS x, round(ny, 6) AS y, 'OKAY' AS status FROM {_HALF.replace('{source}', '(SELECT seed_id, nx AS x, ny AS y FROM ' + _HALF.replace('{source}', _SEED_ROWS) + ')')}")
def advect_over_an_interval(spark, sf_dir):
    got = tracing.advect_interval(rotation_field(spark), _rotation_seeds(spark), 0.0, 1.0)
    return got.select("seed_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "status")


_AGES = _recursion(_HALF, 12)


@query(_AGES + " SELECT s.seed_id AS trace_id, CAST(b AS INTEGER) AS born, CAST(n AS INTEGER) AS step, CAST(n AS DOUBLE) AS t, round(x, 6) AS x, round(y, 6) AS y FROM range(6) o(b), range(1, 7) p(n), s WHERE n > b AND s.seq = 2 * (n - b)")
def streaks_of_a_rotation(spark, sf_dir):
    return fronts.streaklines(rotation_field(spark), _rotation_seeds(spark), 1.0, t_range=(0.0, 6.0)).select("trace_id", "born", "step", "t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_AGES + " SELECT s.seed_id AS trace_id, CAST(b AS INTEGER) AS born, CAST(n AS INTEGER) AS step, CAST(n AS DOUBLE) AS t, round(x, 6) AS x, round(y, 6) AS y FROM range(0, 6, 3) o(b), range(1, 7) p(n), s WHERE n > b AND s.seq = 2 * (n - b)")
def timelines_of_a_rotation(spark, sf_dir):
    return fronts.timelines(rotation_field(spark), _rotation_seeds(spark), 1.0, delay=3, t_range=(0.0, 6.0)).select("trace_id", "born", "step", "t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"SELECT seed_id, CAST(seed_id % 4 + 1 AS INTEGER) AS age, round(nx, 6) AS x, round(ny, 6) AS y FROM {_HALF.replace('{source}', '(SELECT seed_id, nx AS x, ny AS y FROM ' + _HALF.replace('{source}', _SEED_ROWS) + ')')} WHERE seed_id % 4 + 1 <= 3")
def particles_age_out(spark, sf_dir):
    particles = _rotation_seeds(spark).withColumn("age", F.pmod("seed_id", F.lit(4)).cast("int"))
    got = fronts.advance_particles(rotation_field(spark), particles, 0.0, 1.0, life=3)
    return got.select("seed_id", "age", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_linear_rk("rk4").replace("SELECT seed_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM s", "SELECT seed_id AS source_id, CAST(n AS INTEGER) AS sample, seq, round(x, 6) AS x, round(y, 6) AS y FROM s, range(3) q(n)"))
def ensemble_without_spread(spark, sf_dir):
    field = rotation_field(spark)
    field = field.with_nodes(field.nodes.withColumns({f"s{c}": F.lit(0.0) for c in "uvw"}))
    got = tracing.uncertain_streamlines(field, _rotation_seeds(spark), 3, 3, direction=Direction.FORWARD, options=RK4.fixed(0.25), max_points=25)
    return got.select("source_id", "sample", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT id AS source_id, true AS mean_kept, true AS spread_kept FROM range(6) r(id)")
def gaussian_lookup(spark, sf_dir):
    """One step of 4,000 samples a seed through u = 1 with deviation 0.1: mean and deviation of the moves."""
    field = _linear(spark, 5, lambda i, j, k: (i * 0 + 1, j * 0, k * 0))
    field = field.with_nodes(field.nodes.withColumns({"su": F.lit(0.1), "sv": F.lit(0.0), "sw": F.lit(0.0)}))
    seeds = spark.range(6).select(F.col("id").alias("seed_id"), (F.col("id") * 0.3).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))
    got = tracing.uncertain_streamlines(field, seeds, 4000, 3, direction=Direction.FORWARD, options=Integration(order=Order.SECOND).fixed(1.0), max_points=2).where("seq = 1")
    move = F.col("x") - F.col("source_id") * 0.3
    # a second-order step averages two draws: deviation 0.1 / sqrt(2)
    return got.groupBy("source_id").agg((F.abs(F.avg(move) - 1.0) < 0.006).alias("mean_kept"), (F.abs(F.stddev(move) - 0.0707) < 0.005).alias("spread_kept"))


_PIECES = "WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), p AS (SELECT id, CAST(n AS INTEGER) AS n FROM c, range(7) r(n))"


@query(_PIECES + " SELECT id * 4 AS trace, n AS seq, CAST(id AS DOUBLE) AS x, n * 0.5e0 AS y FROM p")
def fragments_connected(spark, sf_dir):
    """Lines of seven points, cut into three fragments that share their ends."""
    c = _customers(spark, sf_dir).where("id % 3 <> 0").select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("f"))
    rows = c.select((F.col("id") * 4 + F.col("f")).alias("fragment"), "id", "f", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"))
    rows = rows.select("fragment", "seq", F.col("id").cast("double").alias("x"), ((F.col("f") * 2 + F.col("seq")) * 0.5).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("t"))
    return lines.connect_fragments(rows).select("trace", "seq", "x", "y")


@query("WITH l AS (SELECT c_custkey AS seed_id, CAST(n AS INTEGER) AS seq, c_custkey % 5 AS last FROM customer, range(5) r(n) WHERE n <= c_custkey % 5) SELECT seed_id, seq, CASE WHEN last > 0 THEN 0e0 END AS tx, CASE WHEN last > 0 THEN 1e0 END AS ty FROM l")
def line_tangents(spark, sf_dir):
    return lines.tangents(customer_lines(spark, sf_dir)).select("seed_id", "seq", (F.col("tx") + F.lit(0.0)).alias("tx"), "ty")


@query("WITH l AS (SELECT c_custkey AS seed_id, CAST(n AS INTEGER) AS seq FROM customer, range(5) r(n) WHERE n <= c_custkey % 5 AND c_custkey % 5 > 0) SELECT seed_id, seq, 6 AS sides, true AS round FROM l")
def line_tubes(spark, sf_dir):
    """Every vertex of a ring lies at the radius from its point and across the line."""
    got = customer_lines(spark, sf_dir).where("seed_id % 5 > 0")
    rings = lines.tubes(got, 0.25, 6).join(got.select("seed_id", "seq", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz")), ["seed_id", "seq"])
    d = tuple(F.col(p) - F.col(f"c{p}") for p in "xyz")
    return rings.groupBy("seed_id", "seq").agg(F.count("*").cast("int").alias("sides"), F.min((F.abs(linalg.norm(d) - 0.25) < 1e-9) & (F.abs(d[1]) < 1e-9)).alias("round"))


_COLOURED = "WITH l AS (SELECT c_custkey AS seed_id, CAST(n AS INTEGER) AS seq FROM customer, range(5) r(n) WHERE n <= c_custkey % 5)"


@query(_COLOURED + " SELECT seed_id, seq, 'all' AS scheme, 0.5e0 AS r, 1e0 AS a FROM l UNION ALL SELECT seed_id, seq, 'trace', CASE WHEN seed_id % 2 = 0 THEN seed_id / 7e0 END, CASE WHEN seed_id % 2 = 0 THEN 1e0 END FROM l UNION ALL SELECT seed_id, seq, 'point', CASE WHEN seq > 0 THEN CAST(seq AS DOUBLE) END, CASE WHEN seq > 0 THEN 1e0 END FROM l")
def line_colours(spark, sf_dir):
    rows = customer_lines(spark, sf_dir)
    rgba = lambda r: (r.alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.lit(1.0).alias("a"))
    by_trace = rows.where("seq = 0 AND seed_id % 2 = 0").select("seed_id", *rgba(F.col("seed_id") / 7.0))
    by_point = rows.where("seq > 0").select("seed_id", "dir", "seq", *rgba(F.col("seq").cast("double")))
    parts = {"all": lines.colour(rows, all_same=(0.5, 0.0, 0.0, 1.0)), "trace": lines.colour(rows, by_trace=by_trace), "point": lines.colour(rows, by_point=by_point)}
    done = [d.select("seed_id", "seq", F.lit(n).alias("scheme"), "r", "a") for n, d in parts.items()]
    return done[0].unionByName(done[1]).unionByName(done[2])


# --- meshes ------------------------------------------------------------------------------------------

_AFFINE = "a AS (SELECT point_id, x / 4e0 AS x, y / 4e0 AS y, z / 4e0 AS z FROM p), b AS (SELECT *, (x - 0.1e0 * y + 0.005e0 * z) / 1.0001e0 AS a FROM a), c AS (SELECT *, z - 0.02e0 * a AS c FROM b), d AS (SELECT *, y - 0.05e0 * c AS b FROM c), e AS (SELECT *, a BETWEEN -1e-9 AND 5e0 + 1e-9 AND b BETWEEN -1e-9 AND 5e0 + 1e-9 AND c BETWEEN -1e-9 AND 5e0 + 1e-9 AS ok FROM d)"


def _affine_grid(spark: SparkSession, n: int = 6) -> tuple[DataFrame, DataFrame]:
    ids = F.col("id")
    lattice = spark.range(n**3).select((ids % n).cast("int").alias("i"), (F.floor(ids / n) % n).cast("int").alias("j"), F.floor(ids / (n * n)).cast("int").alias("k"))
    vertices = lattice.select("i", "j", "k", (F.col("i") + 0.1 * F.col("j")).alias("x"), (F.col("j") + 0.05 * F.col("k")).alias("y"), (F.col("k") + 0.02 * F.col("i")).alias("z"))
    return vertices, vertices.select("i", "j", "k", F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"))


def _quarter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_points(spark, sf_dir).select("point_id", *((F.col(p) / 4.0).alias(p) for p in "xyz"))


@query(f"WITH {_POINTS}, {_AFFINE} SELECT point_id, " + ", ".join(f"CASE WHEN ok THEN round({c}, 6) + 0e0 END AS {n}" for c, n in zip("xyz", "uvw", strict=True)) + " FROM e")
def curvilinear_sample(spark, sf_dir):
    vertices, nodes = _affine_grid(spark)
    return mesh.sample_hexes(_quarter_points(spark, sf_dir), vertices, nodes, (6, 6, 6)).select("point_id", r6("u"), r6("v"), r6("w"))


@query(f"WITH {_POINTS}, {_AFFINE} SELECT point_id, " + ", ".join(f"CASE WHEN ok THEN round({c}, 5) + 0e0 END AS {c}" for c in "abc") + " FROM e")
def curvilinear_coordinates(spark, sf_dir):
    """Cell and local coordinates add up to the place in index space."""
    got = mesh.locate_hexes(_quarter_points(spark, sf_dir), _affine_grid(spark)[0], (6, 6, 6))
    return got.select("point_id", *((F.round(F.col(f"c{p}") + F.col(q), 5) + F.lit(0.0)).alias(q) for p, q in zip("ijk", "abc", strict=True)))


@query("SELECT 125 AS n, true AS equal")
def hex_volumes(spark, sf_dir):
    """Every cell of the affine grid has the map's determinant as volume."""
    cells = mesh.hex_cells(_affine_grid(spark)[0], (6, 6, 6))
    v = mesh.hex_volume(tuple(tuple(F.col(f"{p}{n}") for p in "xyz") for n in range(8)))
    return cells.agg(F.count("*").cast("int").alias("n"), F.min(F.abs(v - 1.0001) < 1e-9).alias("equal"))


@query("WITH c AS (SELECT c_custkey AS id, CAST(c_custkey % 4 AS DOUBLE) / 8e0 AS b1, CAST(c_custkey % 3 AS DOUBLE) / 8e0 AS b2, CAST(c_custkey % 2 AS DOUBLE) / 8e0 AS b3 FROM customer) SELECT id, round(1e0 + 2e0 * b1, 9) AS x, round(3e0 * b2, 9) + 0e0 AS y, round(4e0 * b3, 9) + 0e0 AS z FROM c")
def position_in_tet(spark, sf_dir):
    c = _customers(spark, sf_dir).select("id", (_mod(4) / 8.0).alias("b1"), (_mod(3) / 8.0).alias("b2"), (_mod(2) / 8.0).alias("b3"))
    corners = ((1, 0, 0), (3, 0, 0), (1, 3, 0), (1, 0, 4))
    c = c.withColumns({f"{p}{n}": F.lit(float(v)) for n, q in enumerate(corners) for p, v in zip("xyz", q, strict=True)})
    return mesh.tet_position(c).select("id", *((F.round(p, 9) + F.lit(0.0)).alias(p) for p in "xyz"))


@query("SELECT 0e0 AS xmin, 5.5e0 AS xmax, 0e0 AS ymin, 5.25e0 AS ymax, 0e0 AS zmin, 5.1e0 AS zmax")
def curvilinear_bounds(spark, sf_dir):
    return mesh.surface_box(_affine_grid(spark)[0], (6, 6, 6)).select(*(r6(f"{p}{e}") for p in "xyz" for e in ("min", "max")))


# --- blocks -----------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('12x12x7', 12, 2, 2, 3), ('8x8x8', 8, 2, 2, 2), ('100x10x10', 6, 6, 1, 1), ('5x5x5', 7, 7, 1, 1), ('9x6x3', 6, 2, 3, 1)) v(dims, n, x, y, z)")
def factored_blocks(spark, sf_dir):
    rows = [(d, n, *blocks.factor_blocks(tuple(map(int, d.split("x"))), n)) for d, n in (("12x12x7", 12), ("8x8x8", 8), ("100x10x10", 6), ("5x5x5", 7), ("9x6x3", 6))]
    return spark.createDataFrame(rows, "dims string, n int, x int, y int, z int")


@query("SELECT CAST(id // 4 * 4 AS INTEGER) AS x0, CAST(id // 4 * 4 + 3 AS INTEGER) AS x1, CAST(id // 2 % 2 * 4 AS INTEGER) AS y0, CAST(id // 2 % 2 * 4 + 3 AS INTEGER) AS y1, CAST(id % 2 * 4 AS INTEGER) AS z0, CAST(id % 2 * 4 + 3 AS INTEGER) AS z1 FROM range(8) r(id)")
def bisected_box(spark, sf_dir):
    rows = [(l[0], h[0], l[1], h[1], l[2], h[2]) for l, h in blocks.bisect((0, 0, 0), (7, 7, 7), 3)]
    return spark.createDataFrame(rows, "x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")


@query(_BLOCKS + " SELECT gid, CAST(bx AS INTEGER) AS bx, CAST(by_ AS INTEGER) AS by, CAST(bz AS INTEGER) AS bz, CAST(bt AS INTEGER) AS bt, gid AS rank FROM b")
def lattice_index(spark, sf_dir):
    return blocks.block_index(_blocks(spark).select("gid"), _COUNTS).select("gid", "bx", "by", "bz", "bt", "rank")


@query(_BLOCKS + """, o AS (SELECT a.gid, (a.bx + x + 3) % 3 AS nx, a.by_ + y AS ny, a.bz + z AS nz, a.bt + t AS nt FROM b a, range(-1, 2) p(x), range(-1, 2) q(y), range(-1, 2) r(z), range(-1, 2) s(t))
SELECT DISTINCT gid, CAST(nx + ny * 3 + nz * 6 + nt * 12 AS INTEGER) AS neighbour FROM o WHERE ny BETWEEN 0 AND 1 AND nz BETWEEN 0 AND 1 AND nt BETWEEN 0 AND 1""")
def periodic_neighbours(spark, sf_dir):
    return blocks.lattice_neighbours(_blocks(spark), _COUNTS, periodic=(True, False, False, False))


@query(_BLOCKS + " SELECT gid, CAST(CASE WHEN gid < 20 THEN gid // 5 ELSE 4 + (gid - 20) // 4 END AS INTEGER) AS proc FROM b")
def contiguous_owners(spark, sf_dir):
    return blocks.assign_contiguous(_blocks(spark), 24, 5).select("gid", "proc")


@query(_BLOCKS + " SELECT gid, CAST(gid * 7 % 4 AS INTEGER) AS proc FROM b WHERE gid <> 3")
def explicit_owners(spark, sf_dir):
    owners = spark.range(24).where("id <> 3").select(F.col("id").cast("int").alias("gid"), F.pmod(F.col("id") * 7, F.lit(4)).cast("int").alias("proc"))
    return blocks.assign_explicit(_blocks(spark), owners).select("gid", "proc")


@query(_BLOCKS + """, w AS (SELECT gid, CAST(greatest(gid % 7, 1) AS BIGINT) AS weight FROM b), c AS (SELECT *, sum(weight) OVER (ORDER BY gid) - weight / 2e0 AS done, sum(weight) OVER () AS whole FROM w)
SELECT gid, CAST(least(floor(done * 4 / whole), 3) AS INTEGER) AS proc FROM c""")
def rebalanced_runs(spark, sf_dir):
    b = _blocks(spark)
    weights = b.select(F.col("gid").alias("block"), F.pmod("gid", F.lit(7)).cast("long").alias("weight"))
    return blocks.rebalance(b, weights, 4).select("gid", "proc")


@query("SELECT CAST(id AS INTEGER) AS gid, CAST(id // 8 * 2 + (id // 4) % 2 AS INTEGER) AS proc FROM range(16) r(id)")
def rebalanced_by_bisection(spark, sf_dir):
    """16 blocks in a row of equal weight: two levels of cuts give four runs of four."""
    b = blocks.block_bounds(spark, (17, 3, 3), (16, 1, 1))
    weights = b.select(F.col("gid").alias("block"), F.lit(5).alias("weight"))
    return blocks.rebalance_bisection(b, weights, 2).select("gid", "proc")


@query(_BLOCKS + " SELECT gid FROM b WHERE real_lo_t = 4")
def blocks_of_a_time_group(spark, sf_dir):
    return blocks.in_time_block(_blocks(spark), 1).select("gid")


def _items(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    place = [(n % 12).cast("double").alias("x"), (n * 5 % 12).cast("double").alias("y"), (n * 3 % 7).cast("double").alias("z"), (n % 10).cast("double").alias("t")]
    rows = spark.range(200).select(n.alias("item"), *place)
    return rows.withColumn("block", blocks.point_to_block(_DIMS, _COUNTS)).withColumn("target", F.pmod("item", F.lit(24)).cast("int"))


_ITEMS = """, it AS (SELECT id AS item, id % 12 AS x, id * 5 % 12 AS y, id * 3 % 7 AS z, id % 10 AS t, id % 24 AS target FROM range(200) r(id)),
pl AS (SELECT *, greatest(0, least(ceil(x / 3e0) - 1, 2)) AS a, greatest(0, least(ceil(y / 5e0) - 1, 1)) AS c, greatest(0, least(ceil(z / 3e0) - 1, 1)) AS d, greatest(0, least(ceil(t / 4e0) - 1, 1)) AS e FROM it),
n AS (SELECT item, x, y, z, t, target, gid FROM pl, b WHERE abs(bx - a) <= 1 AND abs(by_ - c) <= 1 AND abs(bz - d) <= 1 AND abs(bt - e) <= 1)"""
_NEAR = " AND ".join(f"{p} BETWEEN CASE WHEN real_lo_{p} - {g} >= 0 THEN real_lo_{p} - {g} ELSE real_lo_{p} END AND CASE WHEN real_hi_{p} + 1 <= {d - 1} THEN real_hi_{p} + 1 ELSE real_hi_{p} END" for p, d, g in zip("xyzt", _DIMS, (1, 1, 1, 0), strict=True))


@query(_BLOCKS + _ITEMS + f" SELECT item, gid AS to_block, 'all' AS how FROM n UNION ALL SELECT item, gid, 'gid' FROM n WHERE gid = target UNION ALL SELECT item, gid, 'near' FROM n JOIN b USING (gid) WHERE {_NEAR}")
def enqueued_items(spark, sf_dir):
    b, items = _blocks(spark), _items(spark)
    pairs = blocks.lattice_neighbours(b, _COUNTS)
    boxes = pairs.join(b.select(F.col("gid").alias("neighbour"), *(f"{s}_{p}" for s in ("lo", "hi") for p in "xyzt")), "neighbour")
    parts = [blocks.enqueue(items, boxes if how == "near" else pairs, how).select("item", "to_block", F.lit(how).alias("how")) for how in ("all", "gid", "near")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_BLOCKS + _ITEMS.replace(", n AS (SELECT", ", n_ AS (SELECT") + " SELECT item, CAST(a + 1 + c * 3 + d * 6 + e * 12 AS INTEGER) AS to_block FROM pl WHERE a + 1 <= 2")
def enqueued_by_direction(spark, sf_dir):
    """Items sent one block on along x."""
    b = _blocks(spark)
    right = blocks.block_index(b.select("gid"), _COUNTS).where("bx < 2").select("gid", (F.col("gid") + 1).alias("neighbour"), F.lit(1).alias("dx"), *(F.lit(0).alias(f"d{p}") for p in "yzt"))
    items = _items(spark).withColumns({"dx": F.lit(1), "dy": F.lit(0), "dz": F.lit(0), "dt": F.lit(0)})
    return blocks.enqueue(items, right, "direction").select("item", "to_block")


@query("SELECT 1 AS level, CAST(ci AS INTEGER) AS ci, CAST(cj AS INTEGER) AS cj, CAST(ck AS INTEGER) AS ck, 2 AS resolution FROM range(4) a(ci), range(2) b(cj), range(2) c(ck) WHERE ci >= 2 UNION ALL SELECT 0, CAST(ci AS INTEGER), 0, 0, 2 FROM range(1) a(ci)")
def amr_merged_children(spark, sf_dir):
    """Two groups of eight children of level 1; one lacks a common resolution and stays."""
    n = F.col("id")
    cells = spark.range(16).select(F.lit(1).alias("level"), (n % 4).cast("int").alias("ci"), (F.floor(n / 4) % 2).cast("int").alias("cj"), F.floor(n / 8).cast("int").alias("ck"))
    cells = cells.withColumn("resolution", F.when((F.col("ci") == 3) & (F.col("cj") == 1) & (F.col("ck") == 1), F.lit(4)).otherwise(F.lit(2)))
    return amr.merge_children(cells, (2, 1, 1)).withColumn("resolution", F.lit(2))


@query("SELECT 1e0 AS min_x, 4e0 AS max_x, 1e0 AS min_z, 4e0 AS max_z")
def amr_block_sizes(spark, sf_dir):
    from .queries import amr_blocks

    return amr.block_size_range(amr_blocks(spark)).select("min_x", "max_x", "min_z", "max_z")


@query(_FIELD + ", p AS (SELECT t, k, j, i, u FROM f WHERE k = 2) SELECT t, k, count(*) AS n, true AS changed FROM p GROUP BY 1, 2")
def lowpass_order_dependent(spark, sf_dir):
    """The in-place variant gives every node of a plane a value, other than the parallel one somewhere."""
    field = lineitem_field(spark, sf_dir)
    plane = field.nodes.where("k = 2").select("t", "i", "j", "k", "u")
    serial = plane.groupBy("t", "k").applyInPandas(lambda p: transform.lowpass_in_place(p), plane.schema)
    both = serial.join(transform.lowpass(field).select("t", "i", "j", "k", F.col("u").alias("other")), ["t", "i", "j", "k"])
    return both.groupBy("t", "k").agg(F.count("*").alias("n"), F.max(F.abs(F.col("u") - F.col("other")) > 1e-9).alias("changed"))


