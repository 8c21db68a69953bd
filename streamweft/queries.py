"""Registered queries: every operator applied to fields, seeds and blocks made from the test
tables, and for most of them the same in DuckDB SQL.

Fields: ``lineitem`` gives a static 12 x 12 x 7 field (part and supplier keys
modulo 12, line number; averages of quantity, discount and tax as velocity),
``events`` a 5 x 5 x 5 field of ten steps.  Seeds are customers, particles
orders, vectors embeddings.  Sums are taken over integers before they are
divided, so both engines get the same doubles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .field import FlowField
from .operators import aggregate, amr, blocks, derive, isosurface, lines, locate, mesh, seeding, transform
from .plans import fronts, rounds, tracing
from .schema import Axis, Direction, Integration, Order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(name: str, alias: str | None = None):
    return (F.round(name, 6) + F.lit(0.0)).alias(alias or name)


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0e0 AS {n}" for n in names)


# --- fields -------------------------------------------------------------------


def lineitem_field(spark: SparkSession, sf_dir: str, n: int = 12) -> FlowField:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    sums = rows.groupBy(F.pmod("l_partkey", F.lit(n)).cast("int").alias("i"), F.pmod("l_suppkey", F.lit(n)).cast("int").alias("j"), (F.col("l_linenumber") - 1).cast("int").alias("k")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"), cents("l_discount").alias("d"), cents("l_tax").alias("x"), F.count("*").alias("c"))
    mean = lambda c, off: F.coalesce(F.col(c).cast("double") / F.col("c") - F.lit(off), F.lit(0.0))
    grid = spark.range(n * n * 7).select((F.col("id") % n).cast("int").alias("i"), (F.floor(F.col("id") / n) % n).cast("int").alias("j"), F.floor(F.col("id") / (n * n)).cast("int").alias("k"))
    nodes = grid.join(sums, ["i", "j", "k"], "left")
    return FlowField.of(nodes.select(F.lit(0).alias("t"), "i", "j", "k", mean("q", 25.5).alias("u"), mean("d", 5.0).alias("v"), mean("x", 4.0).alias("w")), (n, n, 7))


def events_field(spark: SparkSession, sf_dir: str) -> FlowField:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) / 3).cast("int")
    # the few types, sorted, give each its number: no window over all rows
    types = rows.select("event_type").distinct().select(F.array_sort(F.collect_set("event_type")).alias("types"))
    rows = rows.join(F.broadcast(types)).withColumn("k", F.array_position("types", F.col("event_type")).cast("int") - 1)
    cents = F.round(F.col("value") * 100).cast("long")
    sums = rows.groupBy(t.alias("t"), F.pmod("user_id", F.lit(5)).cast("int").alias("i"), F.pmod("event_id", F.lit(5)).cast("int").alias("j"), "k").agg(F.sum(cents % 201).alias("a"), F.sum(cents % 101).alias("b"), F.sum(cents % 51).alias("c"), F.count("*").alias("n"))
    grid = spark.range(1250).select((F.col("id") % 5).cast("int").alias("i"), (F.floor(F.col("id") / 5) % 5).cast("int").alias("j"), (F.floor(F.col("id") / 25) % 5).cast("int").alias("k"), F.floor(F.col("id") / 125).cast("int").alias("t"))
    mean = lambda c, off: F.coalesce((F.col(c).cast("double") / F.col("n") - F.lit(off)) / F.lit(100.0), F.lit(0.0))
    nodes = grid.join(sums, ["t", "i", "j", "k"], "left").select("t", "i", "j", "k", mean("a", 100.0).alias("u"), mean("b", 50.0).alias("v"), mean("c", 25.0).alias("w"))
    return FlowField.of(nodes, (5, 5, 5), t_range=(0, 9))


def rotation_field(spark: SparkSession, n: int = 17, nz: int = 5) -> FlowField:
    """Rigid rotation about the middle of the x-y plane."""
    k, j, i = np.indices((nz, n, n)).astype(float)
    c = (n - 1) / 2
    return FlowField.from_numpy(spark, np.stack([-(j - c) * 0.2, (i - c) * 0.2, np.zeros_like(i)], -1))


_FIELD = """
WITH s AS (
  SELECT CAST(l_partkey % 12 AS INTEGER) AS i, CAST(l_suppkey % 12 AS INTEGER) AS j, CAST(l_linenumber - 1 AS INTEGER) AS k,
         sum(CAST(l_quantity AS BIGINT)) AS q, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(CAST(round(l_tax * 100) AS BIGINT)) AS x, count(*) AS c
  FROM lineitem GROUP BY 1, 2, 3
), g AS (
  SELECT CAST(id % 12 AS INTEGER) AS i, CAST((id // 12) % 12 AS INTEGER) AS j, CAST(id // 144 AS INTEGER) AS k FROM range(1008) r(id)
), f AS (
  SELECT 0 AS t, i, j, k, coalesce(CAST(q AS DOUBLE) / c - 25.5e0, 0e0) AS u, coalesce(CAST(d AS DOUBLE) / c - 5e0, 0e0) AS v,
         coalesce(CAST(x AS DOUBLE) / c - 4e0, 0e0) AS w
  FROM g LEFT JOIN s USING (i, j, k)
)"""
_EVENTS = """
WITH e AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS INTEGER) AS t, CAST(user_id % 5 AS INTEGER) AS i, CAST(event_id % 5 AS INTEGER) AS j,
         CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events
), s AS (
  SELECT t, i, j, k, sum(cents % 201) AS a, sum(cents % 101) AS b, sum(cents % 51) AS c, count(*) AS n FROM e GROUP BY 1, 2, 3, 4
), g AS (
  SELECT CAST(id % 5 AS INTEGER) AS i, CAST((id // 5) % 5 AS INTEGER) AS j, CAST((id // 25) % 5 AS INTEGER) AS k, CAST(id // 125 AS INTEGER) AS t FROM range(1250) r(id)
), f AS (
  SELECT t, i, j, k, coalesce((CAST(a AS DOUBLE) / n - 100e0) / 100e0, 0e0) AS u, coalesce((CAST(b AS DOUBLE) / n - 50e0) / 100e0, 0e0) AS v,
         coalesce((CAST(c AS DOUBLE) / n - 25e0) / 100e0, 0e0) AS w
  FROM g LEFT JOIN s USING (t, i, j, k)
)"""
_NODE = "t, i, j, k, u, v, w"


def customer_points(spark: SparkSession, sf_dir: str, t: bool = False) -> DataFrame:
    """Points in (and slightly outside) index space from customer keys."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    out = rows.select(key.alias("point_id"), (F.pmod(key * 37, F.lit(1200)).cast("double") / 100.0).alias("x"), (F.pmod(key * 53, F.lit(1150)).cast("double") / 100.0).alias("y"), (F.pmod(key * 29, F.lit(640)).cast("double") / 100.0).alias("z"))
    return out.withColumn("t", F.pmod(F.col("point_id") * 7, F.lit(950)).cast("double") / 100.0) if t else out


_POINTS = """p AS (
  SELECT c_custkey AS point_id, CAST(c_custkey * 37 % 1200 AS DOUBLE) / 100e0 AS x, CAST(c_custkey * 53 % 1150 AS DOUBLE) / 100e0 AS y, CAST(c_custkey * 29 % 640 AS DOUBLE) / 100e0 AS z
  FROM customer
)"""

# --- elementwise ----------------------------------------------------------------


@query(_FIELD + f" SELECT {_NODE} FROM f")
def field_from_lineitem(spark, sf_dir):
    return lineitem_field(spark, sf_dir).nodes.select("t", "i", "j", "k", "u", "v", "w")


@query(_EVENTS + f" SELECT {_NODE} FROM f")
def field_from_events(spark, sf_dir):
    return events_field(spark, sf_dir).nodes.select("t", "i", "j", "k", "u", "v", "w")


@query(_FIELD + " SELECT t, i, j, k, u * 2.5e0 AS u, v * 2.5e0 AS v, w * 2.5e0 AS w FROM f")
def field_scale(spark, sf_dir):
    return transform.scale_field(lineitem_field(spark, sf_dir), 2.5).nodes.select("t", "i", "j", "k", "u", "v", "w")


@query(_FIELD + " SELECT t, i, j, k, u + 1e0 AS u, v + -2e0 AS v, w + 0.5e0 AS w FROM f")
def field_translate(spark, sf_dir):
    return transform.translate_field(lineitem_field(spark, sf_dir), 1.0, -2.0, 0.5).nodes.select("t", "i", "j", "k", "u", "v", "w")


_LEN = "sqrt(u * u + v * v + w * w)"


@query(_FIELD + f", n AS (SELECT *, {_LEN} AS m FROM f) SELECT t, i, j, k, " + ", ".join(f"round(CASE WHEN m = 0 THEN {c} ELSE {c} / m END, 6) + 0e0 AS {c}" for c in "uvw") + " FROM n")
def normalize_local(spark, sf_dir):
    return transform.normalize_local(lineitem_field(spark, sf_dir)).nodes.select("t", "i", "j", "k", r6("u"), r6("v"), r6("w"))


@query(_FIELD + f", n AS (SELECT max({_LEN}) AS m FROM f) SELECT t, i, j, k, " + ", ".join(f"round({c} / m, 6) + 0e0 AS {c}" for c in "uvw") + " FROM f, n")
def normalize_global(spark, sf_dir):
    return transform.normalize_global(lineitem_field(spark, sf_dir)).nodes.select("t", "i", "j", "k", r6("u"), r6("v"), r6("w"))


@query("""SELECT vec_id, round(sqrt(x * x + y * y + z * z), 6) AS magnitude, greatest(x, y, z) AS largest, least(x, 1e0) AS clamped, abs(x) < 1e-5 AND abs(y) < 1e-5 AND abs(z) < 1e-5 AS stationary
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)""")
def vector_functions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *(F.get("embedding", F.lit(n)).cast("double").alias(c) for n, c in enumerate("uvw")))
    return e.select("vec_id", F.round(transform.magnitude(), 6).alias("magnitude"), transform.max_component("u", "v", "w").alias("largest"), transform.clamp("u").alias("clamped"), transform.stationary().alias("stationary"))


@query("WITH " + _POINTS + " SELECT point_id, x, y, z FROM p WHERE x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 8.5e0 AND z BETWEEN 0 AND 4")
def points_in_box(spark, sf_dir):
    return customer_points(spark, sf_dir).where(transform.in_box((2, 1, 0), (9, 8.5, 4)))


@query(_FIELD + f" SELECT {_NODE} FROM f WHERE k = 3")
def slice_z(spark, sf_dir):
    return transform.slice_at(lineitem_field(spark, sf_dir), Axis.Z, 3).select("t", "i", "j", "k", "u", "v", "w")


def _region_sql(op: str) -> str:
    parts = []
    for a, v, n in (("i", "u", 12), ("j", "v", 12), ("k", "w", 7)):
        parts += [f"SELECT {_NODE}, '{a}0' AS face FROM f WHERE {a} = 0 AND {v} {op} 0", f"SELECT {_NODE}, '{a}1' AS face FROM f WHERE {a} = {n - 1} AND -{v} {op} 0"]
    return _FIELD + " " + " UNION ALL ".join(parts)


@query(_region_sql(">"))
def inflow_region(spark, sf_dir):
    return transform.boundary_region(lineitem_field(spark, sf_dir), "inflow")


@query(_region_sql("<"))
def outflow_region(spark, sf_dir):
    return transform.boundary_region(lineitem_field(spark, sf_dir), "outflow")


@query(_region_sql("="))
def tangential_region(spark, sf_dir):
    return transform.boundary_region(lineitem_field(spark, sf_dir), "tangential")


@query(_FIELD + f" SELECT {_NODE} FROM f WHERE j = 5 AND v > 0")
def inflow_slice(spark, sf_dir):
    return transform.slice_region(lineitem_field(spark, sf_dir), Axis.Y, 5, "inflow").select("t", "i", "j", "k", "u", "v", "w")


@query(_FIELD + """, o AS (SELECT a, b, CAST((2 - abs(a)) * (2 - abs(b)) AS DOUBLE) AS weight FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b))
SELECT f.t, CAST(f.i + a AS INTEGER) AS i, CAST(f.j + b AS INTEGER) AS j, f.k, round(sum(u * weight) / sum(weight), 6) + 0e0 AS u FROM f, o
WHERE f.i + a BETWEEN 0 AND 11 AND f.j + b BETWEEN 0 AND 11 GROUP BY ALL""")
def lowpass_jacobi(spark, sf_dir):
    return transform.lowpass(lineitem_field(spark, sf_dir)).select("t", "i", "j", "k", r6("u"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN rho = 0 THEN 0e0 ELSE l_extendedprice / rho END AS u, CASE WHEN rho = 0 THEN 0e0 ELSE l_discount / rho END AS v, CASE WHEN rho = 0 THEN 0e0 ELSE l_tax / rho END AS w
FROM (SELECT *, l_quantity - 10e0 AS rho FROM lineitem)""")
def momentum_to_velocity(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 10.0).alias("rho"), F.col("l_extendedprice").alias("mx"), F.col("l_discount").alias("my"), F.col("l_tax").alias("mz"))
    return transform.momentum_to_velocity(rows).select("l_orderkey", "l_linenumber", "u", "v", "w")


# --- location and sampling ----------------------------------------------------------

_LOCATED = f"""{_FIELD}, {_POINTS}, c AS (
  SELECT point_id, x, y, z, CASE WHEN ok THEN CAST(least(floor(x), 10) AS INTEGER) END AS ci, CASE WHEN ok THEN CAST(least(floor(y), 10) AS INTEGER) END AS cj,
         CASE WHEN ok THEN CAST(least(floor(z), 5) AS INTEGER) END AS ck
  FROM (SELECT *, x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 11 AND z BETWEEN 0 AND 6 AS ok FROM p)
)"""


@query(_LOCATED + " SELECT point_id, ci, cj, ck, CAST(coalesce(ck * 121 + cj * 11 + ci, -1) AS BIGINT) AS cell, x - ci AS a, y - cj AS b, z - ck AS c FROM c")
def locate_cells(spark, sf_dir):
    return locate.locate_cells(customer_points(spark, sf_dir), lineitem_field(spark, sf_dir)).select("point_id", "ci", "cj", "ck", "cell", "a", "b", "c")


@query(_LOCATED + """ SELECT point_id, CAST(n AS INTEGER) AS corner, CAST(ck + n // 4 AS BIGINT) * 144 + (cj + (n // 2) % 2) * 12 + ci + n % 2 AS node FROM c, range(8) r(n) WHERE ci IS NOT NULL""")
def cell_vertices(spark, sf_dir):
    field = lineitem_field(spark, sf_dir)
    return locate.cell_vertices(locate.locate_cells(customer_points(spark, sf_dir), field).where("cell >= 0"), field).select("point_id", "corner", "node")


_SAMPLED = _LOCATED + """, w AS (
  SELECT point_id, ci + n % 2 AS i, cj + (n // 2) % 2 AS j, ck + n // 4 AS k,
         (CASE WHEN n % 2 = 1 THEN x - ci ELSE 1 - (x - ci) END) * (CASE WHEN (n // 2) % 2 = 1 THEN y - cj ELSE 1 - (y - cj) END) * (CASE WHEN n // 4 = 1 THEN z - ck ELSE 1 - (z - ck) END) AS weight
  FROM c, range(8) r(n) WHERE ci IS NOT NULL
), m AS (SELECT point_id, sum(weight * u) AS u, sum(weight * v) AS v, sum(weight * w) AS w FROM w JOIN f USING (i, j, k) GROUP BY 1)"""


@query(_SAMPLED + f" SELECT point_id, {_r6('u', 'v', 'w')} FROM p LEFT JOIN m USING (point_id)")
def trilinear_sample(spark, sf_dir):
    return locate.sample(customer_points(spark, sf_dir), lineitem_field(spark, sf_dir)).select("point_id", r6("u"), r6("v"), r6("w"))


@query(_EVENTS + """, p AS (SELECT c_custkey AS point_id, CAST(c_custkey * 7 % 950 AS DOUBLE) / 100e0 AS t, CAST(c_custkey % 5 AS INTEGER) AS i, CAST(c_custkey // 5 % 5 AS INTEGER) AS j, CAST(c_custkey // 25 % 5 AS INTEGER) AS k FROM customer)
SELECT point_id, round(a.u * (1 - (p.t - floor(p.t))) + b.u * (p.t - floor(p.t)), 9) + 0e0 AS u, round(a.v * (1 - (p.t - floor(p.t))) + b.v * (p.t - floor(p.t)), 9) + 0e0 AS v, round(a.w * (1 - (p.t - floor(p.t))) + b.w * (p.t - floor(p.t)), 9) + 0e0 AS w
FROM p LEFT JOIN f a ON a.t = floor(p.t) AND p.t <= 9 AND a.i = p.i AND a.j = p.j AND a.k = p.k LEFT JOIN f b ON b.t = least(floor(p.t) + 1, 9) AND p.t <= 9 AND b.i = p.i AND b.j = p.j AND b.k = p.k""")
def temporal_lerp(spark, sf_dir):
    key = F.col("c_custkey")
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("point_id"), (F.pmod(key * 7, F.lit(950)).cast("double") / 100.0).alias("t"), *((F.floor(key / n) % 5).cast("double").alias(c) for n, c in ((1, "x"), (5, "y"), (25, "z"))))
    return locate.sample(p, events_field(spark, sf_dir)).select("point_id", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in "uvw"))


@query("WITH " + _POINTS + """, e AS (SELECT *, x + (CAST(point_id % 7 AS DOUBLE) - 3) * 4 AS x1, y + (CAST(point_id % 5 AS DOUBLE) - 2) * 4 AS y1, z + (CAST(point_id % 3 AS DOUBLE) - 1) * 4 AS z1 FROM p WHERE x <= 11 AND y <= 11 AND z <= 6),
s AS (SELECT *, greatest(0e0, least(1e0, CASE WHEN x1 - x > 0 THEN (11e0 - x) / (x1 - x) WHEN x1 - x < 0 THEN (0e0 - x) / (x1 - x) ELSE 1e0 END, CASE WHEN y1 - y > 0 THEN (11e0 - y) / (y1 - y) WHEN y1 - y < 0 THEN (0e0 - y) / (y1 - y) ELSE 1e0 END,
 CASE WHEN z1 - z > 0 THEN (6e0 - z) / (z1 - z) WHEN z1 - z < 0 THEN (0e0 - z) / (z1 - z) ELSE 1e0 END)) AS s FROM e)
SELECT point_id, round(s, 6) + 0e0 AS s, round(x + s * (x1 - x), 6) + 0e0 AS xb, round(y + s * (y1 - y), 6) + 0e0 AS yb, round(z + s * (z1 - z), 6) + 0e0 AS zb FROM s""")
def bbox_clip(spark, sf_dir):
    move = lambda c, m, n: F.col(c) + (F.pmod("point_id", F.lit(m)).cast("double") - n) * 4
    seg = customer_points(spark, sf_dir).where("x <= 11 AND y <= 11 AND z <= 6").withColumns({"x1": move("x", 7, 3), "y1": move("y", 5, 2), "z1": move("z", 3, 1)})
    return locate.clip_to_box(seg, (0, 0, 0), (11, 11, 6)).select("point_id", r6("s"), r6("xb"), r6("yb"), r6("zb"))


# --- derivatives ----------------------------------------------------------------------


def _neighbours(columns: str = "uvw") -> str:
    parts = []
    for c in columns:
        for a, others in (("i", "j, k"), ("j", "i, k"), ("k", "i, j")):
            parts += [f"lag({c}) OVER (PARTITION BY t, {others} ORDER BY {a}) AS {c}_{a}m", f"lead({c}) OVER (PARTITION BY t, {others} ORDER BY {a}) AS {c}_{a}p"]
    return _FIELD + ", n AS (SELECT f.*, " + ", ".join(parts) + " FROM f)"


def _d(c: str, a: str) -> str:
    return f"((coalesce({c}_{a}p, {c}) - coalesce({c}_{a}m, {c})) / (CASE WHEN {c}_{a}m IS NULL OR {c}_{a}p IS NULL THEN 1e0 ELSE 2e0 END))"


@query(_neighbours() + f" SELECT t, i, j, k, {_d('w', 'j')} - {_d('v', 'k')} AS u, {_d('u', 'k')} - {_d('w', 'i')} AS v, {_d('v', 'i')} - {_d('u', 'j')} AS w FROM n")
def vorticity(spark, sf_dir):
    return derive.vorticity(lineitem_field(spark, sf_dir)).nodes


def _lap(c: str) -> str:
    terms = " + ".join(f"({c}_{a}m - 2e0 * {c} + {c}_{a}p)" for a in "ijk")
    return f"CASE WHEN i BETWEEN 1 AND 10 AND j BETWEEN 1 AND 10 AND k BETWEEN 1 AND 5 THEN {terms} ELSE 0e0 END AS {c}"


@query(_neighbours() + f" SELECT t, i, j, k, {', '.join(map(_lap, 'uvw'))} FROM n")
def laplacian(spark, sf_dir):
    return derive.laplacian(lineitem_field(spark, sf_dir)).nodes


_JAC = _neighbours() + ", jac AS (SELECT t, i, j, k, u, v, w, " + ", ".join(f"{_d(c, a)} AS j{r}{s}" for r, c in enumerate("uvw") for s, a in enumerate("ijk")) + " FROM n)"


@query(_JAC + " SELECT * FROM jac")
def jacobian(spark, sf_dir):
    return derive.jacobian_nodes(lineitem_field(spark, sf_dir))


@query(_JAC + """, m AS (SELECT *, j00 * j00 + j11 * j11 + j22 * j22 + 2 * (j01 * j10 + j02 * j20 + j12 * j21) AS jj,
  j00 * (j11 * j22 - j12 * j21) + j01 * (j12 * j20 - j10 * j22) + j02 * (j10 * j21 - j11 * j20) AS det FROM jac)
SELECT t, i, j, k, round(-0.5e0 * jj, 6) + 0e0 AS q, round(power(-0.5e0 * jj / 3, 3) + (det / 2) * (det / 2), 4) + 0e0 AS delta FROM m""")
def q_delta(spark, sf_dir):
    got = derive.vortex_metrics(derive.jacobian_nodes(lineitem_field(spark, sf_dir)))
    return got.select("t", "i", "j", "k", r6("q"), (F.round("delta", 4) + F.lit(0.0)).alias("delta"))


@query(_JAC + """ SELECT t, i, j, k, round(j00 + j11 + j22, 6) + 0e0 AS divergence, round(j00 * (j11 * j22 - j12 * j21) + j01 * (j12 * j20 - j10 * j22) + j02 * (j10 * j21 - j11 * j20), 6) + 0e0 AS det_j, round(sqrt(u * u + v * v + w * w), 6) + 0e0 AS speed FROM jac""")
def divergence_det(spark, sf_dir):
    return derive.gradient_scalars(derive.jacobian_nodes(lineitem_field(spark, sf_dir))).select("t", "i", "j", "k", r6("divergence"), r6("det_j"), r6("speed"))


@query(_JAC + """, h AS (SELECT *, sqrt(u * u + v * v + w * w) AS m FROM jac), n2 AS (SELECT *, CASE WHEN m = 0 THEN u ELSE u / m END AS a, CASE WHEN m = 0 THEN v ELSE v / m END AS b, CASE WHEN m = 0 THEN w ELSE w / m END AS c FROM h)
SELECT t, i, j, k, round(sqrt(power(j00 * a + j01 * b + j02 * c, 2) + power(j10 * a + j11 * b + j12 * c, 2) + power(j20 * a + j21 * b + j22 * c, 2)), 6) + 0e0 AS curvature FROM n2""")
def curvature(spark, sf_dir):
    return derive.curvature(derive.jacobian_nodes(lineitem_field(spark, sf_dir))).select("t", "i", "j", "k", r6("curvature"))


@query()
def critical_point_kinds(spark, sf_dir):
    return derive.classify_critical_points(isosurface.critical_points(lineitem_field(spark, sf_dir))).select("t", r6("x"), r6("y"), r6("z"), "kind")


_CELLS = """, o AS (SELECT t, i - n % 2 AS ci, j - (n // 2) % 2 AS cj, k - n // 4 AS ck, u, v, w FROM f, range(8) r(n)),
c AS (SELECT t, ci, cj, ck, min(u) AS lo, max(u) AS hi, min(v) AS lo2, max(v) AS hi2, min(w) AS lo3, max(w) AS hi3 FROM o WHERE ci BETWEEN 0 AND 10 AND cj BETWEEN 0 AND 10 AND ck BETWEEN 0 AND 5 GROUP BY t, ci, cj, ck)"""
_CI = "t, CAST(ci AS INTEGER) AS ci, CAST(cj AS INTEGER) AS cj, CAST(ck AS INTEGER) AS ck"


@query(_FIELD + _CELLS + f" SELECT {_CI} FROM c WHERE lo <= 0.5e0 AND hi >= 0.5e0")
def iso_cells(spark, sf_dir):
    return isosurface.iso_cells(lineitem_field(spark, sf_dir), "u", 0.5).select("t", "ci", "cj", "ck")


@query(_FIELD + _CELLS + f" SELECT {_CI} FROM c WHERE lo <= 0 AND hi >= 0 AND lo2 <= 0 AND hi2 >= 0 AND lo3 <= 0 AND hi3 >= 0")
def critical_cells(spark, sf_dir):
    return isosurface.critical_cells(lineitem_field(spark, sf_dir)).select("t", "ci", "cj", "ck")


@query()
def iso_surface(spark, sf_dir):
    return isosurface.iso_surface(lineitem_field(spark, sf_dir), "u", [0.0, 0.5])


# --- aggregation -------------------------------------------------------------------------


@query(_EVENTS + """, m AS (SELECT *, u * u + v * v + w * w AS m FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY m, k, j, i) AS a, row_number() OVER (PARTITION BY t ORDER BY m DESC, k, j, i) AS b FROM m)
SELECT x.t, x.i AS min_i, x.j AS min_j, x.k AS min_k, y.i AS max_i, y.j AS max_j, y.k AS max_k, round(sqrt(x.m), 6) AS min_mag, round(sqrt(y.m), 6) AS max_mag FROM r x JOIN r y ON x.t = y.t WHERE x.a = 1 AND y.b = 1""")
def extrema_per_step(spark, sf_dir):
    got = aggregate.extrema_per_step(events_field(spark, sf_dir).nodes)
    return got.select("t", "min_i", "min_j", "min_k", "max_i", "max_j", "max_k", F.round("min_mag", 6).alias("min_mag"), F.round("max_mag", 6).alias("max_mag"))


@query(_EVENTS + ", m AS (SELECT t, u * u + v * v + w * w AS m FROM f) SELECT arg_min(t, (m, t)) AS min_t, round(sqrt(min(m)), 6) AS min_mag, arg_min(t, (-m, t)) AS max_t, round(sqrt(max(m)), 6) AS max_mag FROM m")
def extrema_all(spark, sf_dir):
    return aggregate.extrema_all(events_field(spark, sf_dir).nodes).select("min_t", F.round("min_mag", 6).alias("min_mag"), "max_t", F.round("max_mag", 6).alias("max_mag"))


@query("WITH " + _POINTS + " SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM p")
def bounding_box(spark, sf_dir):
    return aggregate.bounding_box(customer_points(spark, sf_dir))


_RUN = """WITH r AS (SELECT CAST(o_custkey % 16 AS INTEGER) AS proc, count(*) AS seeds, sum(CAST(o_totalprice AS BIGINT) % 100) AS steps FROM orders GROUP BY 1),
l AS (SELECT proc, 'seeds' AS metric, CAST(seeds AS DOUBLE) AS value FROM r UNION ALL SELECT proc, 'steps', CAST(steps AS DOUBLE) FROM r)
SELECT metric, sum(value) AS total, min(value) AS min, arg_min(proc, (value, proc)) AS argmin, max(value) AS max, arg_min(proc, (-value, proc)) AS argmax, floor(avg(value)) AS mean,
round(var_pop(value) + power(avg(value) - floor(avg(value)), 2), 4) AS variance FROM l GROUP BY metric"""


@query(_RUN)
def run_stats(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    r = o.groupBy(F.pmod("o_custkey", F.lit(16)).cast("int").alias("proc")).agg(F.count("*").alias("seeds"), F.sum(F.rint("o_totalprice").cast("long") % 100).alias("steps"))
    return aggregate.run_statistics(r, "proc", "seeds", "steps", integer_means=True).drop("std").withColumn("variance", F.round("variance", 4))


@query("SELECT CAST(o_custkey % 12 AS INTEGER) AS from_block, CAST(l_suppkey % 12 AS INTEGER) AS to_block, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def flow_matrix(spark, sf_dir):
    moves = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    return aggregate.flow_matrix(moves.select(F.pmod("o_custkey", F.lit(12)).cast("int").alias("from_block"), F.pmod("l_suppkey", F.lit(12)).cast("int").alias("to_block")))


@query("SELECT CAST(l_partkey % 64 AS INTEGER) AS block, sum(l_linenumber) AS weight FROM lineitem GROUP BY 1")
def block_weights(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.pmod("l_partkey", F.lit(64)).cast("int").alias("block"), F.col("l_linenumber").alias("steps"))
    return aggregate.block_weights(rows).withColumn("weight", F.col("weight").cast("long"))


def _order_lines(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("seed_id"), F.lit(1).alias("dir"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.col("l_linenumber").cast("double").alias("t"))


_ONE = "lines AS (SELECT l_orderkey AS seed_id, 1 AS dir, l_linenumber AS seq, min(l_quantity) AS x, CAST(l_linenumber AS DOUBLE) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_LINES = "lines AS (SELECT l_orderkey AS seed_id, 1 AS dir, l_linenumber AS seq, l_quantity AS x, l_discount AS y, l_tax AS z, CAST(l_linenumber AS DOUBLE) AS t FROM lineitem)"


@query(f"WITH {_LINES}, c AS (SELECT seed_id, dir, count(*) AS n FROM lines GROUP BY ALL) SELECT count(*) AS n_traces, CAST(sum(n) AS BIGINT) AS n_points, max(n) AS longest FROM c")
def trace_summary(spark, sf_dir):
    return aggregate.trace_summary(_order_lines(spark, sf_dir))


@query(f"WITH {_LINES}, c AS (SELECT seed_id, dir, count(*) AS n_points FROM lines GROUP BY ALL) SELECT seed_id, dir, n_points, CAST(coalesce(sum(n_points) OVER (ORDER BY seed_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM c")
def writer_offsets(spark, sf_dir):
    return lines.writer_offsets(_order_lines(spark, sf_dir))


@query(f"""WITH {_ONE}, g AS (SELECT seed_id, dir, lag(seq) OVER w AS seq, lag(x) OVER w AS x0, lag(t) OVER w AS t0, x AS x1, t AS t1 FROM lines WINDOW w AS (PARTITION BY seed_id ORDER BY seq)),
h AS (SELECT *, (greatest(1.5e0, least(3.25e0, t0)) - t0) / (t1 - t0) AS a, (greatest(1.5e0, least(3.25e0, t1)) - t0) / (t1 - t0) AS b FROM g WHERE seq IS NOT NULL AND least(t0, t1) <= 3.25e0 AND greatest(t0, t1) >= 1.5e0)
SELECT seed_id, dir, seq, round(x0 + a * (x1 - x0), 6) AS x0, round(t0 + a * (t1 - t0), 6) AS t0, round(x0 + b * (x1 - x0), 6) AS x1, round(t0 + b * (t1 - t0), 6) AS t1 FROM h""")
def time_slab(spark, sf_dir):
    return lines.time_slab(_order_lines(spark, sf_dir).groupBy("seed_id", "dir", "seq").agg(*(F.min(c).alias(c) for c in "xyzt")), 1.5, 3.25).select("seed_id", "dir", "seq", *(F.round(c, 6).alias(c) for c in ("x0", "t0", "x1", "t1")))


@query(f"WITH {_LINES} SELECT seed_id, seq, x FROM lines WHERE seq % 3 = 1")
def animation_frame(spark, sf_dir):
    return lines.animation_frame(_order_lines(spark, sf_dir), 1, 3).select("seed_id", "seq", "x")


@query(f"WITH {_LINES} SELECT seed_id, seq, CAST(seq AS DOUBLE) / count(*) OVER (PARTITION BY seed_id) AS t FROM lines")
def pseudo_times(spark, sf_dir):
    return lines.pseudo_times(_order_lines(spark, sf_dir)).select("seed_id", "seq", "t")


# --- seeds, blocks -------------------------------------------------------------------------


@query("SELECT id AS seed_id, 1e0 + (CAST(id + 1 AS DOUBLE) / 101e0) * 9e0 AS x, 2e0 + 0e0 AS y, 3e0 + 0e0 AS z FROM range(100) r(id)")
def rake_line(spark, sf_dir):
    return seeding.regular_seeds(spark, (1, 2, 3), (10, 2, 3), [100])


@query("SELECT id AS seed_id, 1e0 + (CAST(id % 20 AS DOUBLE) / 19e0) * 9e0 AS x, 2e0 + 0e0 AS y, 0e0 + (CAST(id // 20 AS DOUBLE) / 9e0) * 6e0 AS z FROM range(200) r(id)")
def rake_plane(spark, sf_dir):
    return seeding.regular_seeds(spark, (1, 2, 0), (10, 2, 6), [20, 10])


@query("SELECT id AS seed_id, 1e0 + (CAST(id % 10 AS DOUBLE) / 9e0) * 9e0 AS x, 2e0 + (CAST((id // 10) % 10 AS DOUBLE) / 9e0) * 6e0 AS y, 0e0 + (CAST(id // 100 AS DOUBLE) / 4e0) * 6e0 AS z FROM range(500) r(id)")
def rake_solid(spark, sf_dir):
    return seeding.regular_seeds(spark, (1, 2, 0), (10, 8, 6), [10, 10, 5])


@query()
def random_seeds(spark, sf_dir):
    return seeding.random_seeds(spark, (0, 0, 0), (11, 11, 6), 500, 7)


@query("WITH " + _POINTS + " SELECT point_id * 4 + n AS seed_id, point_id AS source_id, CAST(n AS INTEGER) AS sample FROM p, range(4) r(n)")
def ensemble_seeds(spark, sf_dir):
    return seeding.ensemble_seeds(customer_points(spark, sf_dir).withColumnRenamed("point_id", "seed_id"), 4).select("seed_id", "source_id", "sample")


_DIMS, _COUNTS = (12, 12, 7, 10), (3, 2, 2, 2)


def _blocks(spark):
    return blocks.with_ghosts(blocks.block_bounds(spark, _DIMS, _COUNTS), _DIMS)


_BLOCKS = """WITH l AS (SELECT CAST(id AS INTEGER) AS gid, CAST(id % 3 AS INTEGER) AS bx, CAST(id // 3 % 2 AS INTEGER) AS by_, CAST(id // 6 % 2 AS INTEGER) AS bz, CAST(id // 12 AS INTEGER) AS bt FROM range(24) r(id)),
b AS (SELECT *, bx * 3 AS real_lo_x, CASE WHEN bx = 2 THEN 11 ELSE bx * 3 + 3 END AS real_hi_x, by_ * 5 AS real_lo_y, CASE WHEN by_ = 1 THEN 11 ELSE by_ * 5 + 5 END AS real_hi_y,
bz * 3 AS real_lo_z, CASE WHEN bz = 1 THEN 6 ELSE bz * 3 + 3 END AS real_hi_z, bt * 4 AS real_lo_t, CASE WHEN bt = 1 THEN 9 ELSE bt * 4 + 4 END AS real_hi_t FROM l)"""
_REAL = ", ".join(f"real_{s}_{p}" for s in ("lo", "hi") for p in "xyzt")


@query(_BLOCKS + f" SELECT gid, {_REAL} FROM b")
def decompose(spark, sf_dir):
    return blocks.block_bounds(spark, _DIMS, _COUNTS).select("gid", *_REAL.split(", "))


_GHOSTS = ", ".join([f"CASE WHEN real_lo_{p} - {g} >= 0 THEN real_lo_{p} - {g} ELSE real_lo_{p} END AS lo_{p}, CASE WHEN real_hi_{p} + 1 <= {d - 1} THEN real_hi_{p} + 1 ELSE real_hi_{p} END AS hi_{p}" for p, d, g in zip("xyzt", _DIMS, (1, 1, 1, 0), strict=True)])


@query(_BLOCKS + f" SELECT gid, {_GHOSTS} FROM b")
def ghost_blocks(spark, sf_dir):
    return _blocks(spark).select("gid", *(f"{s}_{p}" for p in "xyzt" for s in ("lo", "hi")))


@query(_BLOCKS + """ SELECT a.gid, b.gid AS neighbour FROM b a, b WHERE abs(a.bx - b.bx) <= 1 AND abs(a.by_ - b.by_) <= 1 AND abs(a.bz - b.bz) <= 1 AND abs(a.bt - b.bt) <= 1""")
def lattice_neighbours(spark, sf_dir):
    return blocks.lattice_neighbours(_blocks(spark), _COUNTS)


@query("WITH " + _POINTS + """, q AS (SELECT *, CAST(point_id * 7 % 950 AS DOUBLE) / 100e0 AS t FROM p),
l AS (SELECT point_id, x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 11 AND z BETWEEN 0 AND 6 AND t BETWEEN 0 AND 9 AS ok, greatest(0, least(ceil(x / 3e0) - 1, 2)) AS a, greatest(0, least(ceil(y / 5e0) - 1, 1)) AS b, greatest(0, least(ceil(z / 3e0) - 1, 1)) AS c, greatest(0, least(ceil(t / 4e0) - 1, 1)) AS d FROM q)
SELECT point_id, CAST(CASE WHEN ok THEN a + b * 3 + c * 6 + d * 12 ELSE -1 END AS INTEGER) AS block FROM l""")
def point_to_block(spark, sf_dir):
    return customer_points(spark, sf_dir, t=True).select("point_id", blocks.point_to_block(_DIMS, _COUNTS).alias("block"))


@query(_BLOCKS + ", " + _POINTS + """, q AS (SELECT *, CAST(point_id * 7 % 950 AS DOUBLE) / 100e0 AS t FROM p)
SELECT point_id AS seed_id, coalesce(min(gid), -1) AS block FROM q LEFT JOIN b ON x BETWEEN real_lo_x AND real_hi_x AND y BETWEEN real_lo_y AND real_hi_y AND z BETWEEN real_lo_z AND real_hi_z AND t BETWEEN real_lo_t AND real_hi_t GROUP BY 1""")
def assign_seeds(spark, sf_dir):
    seeds = customer_points(spark, sf_dir, t=True).withColumnRenamed("point_id", "seed_id")
    return seeding.assign_seeds(seeds, _blocks(spark)).select("seed_id", "block")


@query(_BLOCKS + """ SELECT CAST(row_number() OVER (ORDER BY tmin, tmax) - 1 AS INTEGER) AS "group", tmin, tmax FROM (SELECT DISTINCT real_lo_t AS tmin, real_hi_t AS tmax FROM b)""")
def time_groups(spark, sf_dir):
    return blocks.time_groups(_blocks(spark))


@query(_BLOCKS + ", " + _POINTS + """, q AS (SELECT CAST(point_id * 7 % 950 AS DOUBLE) / 100e0 AS t FROM p), g AS (SELECT DISTINCT real_lo_t AS tmin, real_hi_t AS tmax FROM b)
SELECT tmin, tmax, count(t) AS n_seeds, count(t) > 0 AS has_seeds FROM g LEFT JOIN q ON t BETWEEN tmin AND tmax GROUP BY ALL""")
def seeds_in_time_groups(spark, sf_dir):
    seeds = customer_points(spark, sf_dir, t=True)
    return aggregate.seeds_in_range(seeds, blocks.time_groups(_blocks(spark))).select("tmin", "tmax", "n_seeds", "has_seeds")


@query(_BLOCKS + " SELECT gid, CAST(gid % 5 AS INTEGER) AS proc FROM b")
def round_robin(spark, sf_dir):
    return blocks.assign_round_robin(_blocks(spark), 5).select("gid", "proc")


@query(_BLOCKS + " SELECT a.gid, b.gid AS other FROM b a JOIN b ON " + " AND ".join(f"a.real_lo_{p} <= b.real_hi_{p} AND a.real_hi_{p} >= b.real_lo_{p}" for p in "xyzt"))
def overlapping_blocks(spark, sf_dir):
    return blocks.overlapping(_blocks(spark), _blocks(spark))


@query(_FIELD + """, x AS (SELECT CAST(a AS INTEGER) AS block, a * 3 - CASE WHEN a > 0 THEN 1 ELSE 0 END AS lo, CASE WHEN a = 2 THEN 11 ELSE a * 3 + 4 END AS hi FROM range(3) r(a))
SELECT block, t, i, j, k, u, v, w FROM f JOIN x ON i BETWEEN lo AND hi""")
def halo_nodes(spark, sf_dir):
    three = blocks.with_ghosts(blocks.block_bounds(spark, (12, 12, 7, 1), (3, 1, 1, 1)), (12, 12, 7, 1))
    return blocks.halo_nodes(lineitem_field(spark, sf_dir).nodes, three).select("block", "t", "i", "j", "k", "u", "v", "w")


# --- meshes and adaptive blocks --------------------------------------------------------------

_SIX = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


def cube_mesh(spark: SparkSession, n: int = 4) -> tuple[DataFrame, DataFrame]:
    """Vertices of an n^3 lattice and six tetrahedra a cell."""
    ids = F.col("id")
    vertices = spark.range(n**3).select(ids.alias("vid"), (ids % n).cast("double").alias("x"), (F.floor(ids / n) % n).cast("double").alias("y"), F.floor(ids / (n * n)).cast("double").alias("z"))
    m = n - 1
    cell = spark.range(m**3).select(ids.alias("cell"), (ids % m + (F.floor(ids / m) % m) * n + F.floor(ids / (m * m)) * n * n).alias("base"))
    corner = [(c & 1) + (c >> 1 & 1) * n + (c >> 2) * n * n for c in range(8)]
    tets = F.array(*(F.struct(F.lit(k).alias("k"), *((F.col("base") + corner[c]).alias(f"v{q}") for q, c in enumerate(t))) for k, t in enumerate(_SIX)))
    out = cell.select("cell", F.explode(tets).alias("t"))
    return vertices, out.select((F.col("cell") * 6 + F.col("t.k")).alias("tid"), *(F.col(f"t.v{q}").cast("long").alias(f"v{q}") for q in range(4)))


_TETS = "WITH cell AS (SELECT id AS cell, id % 3 + (id // 3 % 3) * 4 + id // 9 * 16 AS base FROM range(27) r(id)), tet AS (" + " UNION ALL ".join(
    f"SELECT cell * 6 + {k} AS tid, " + ", ".join(f"base + {(c & 1) + (c >> 1 & 1) * 4 + (c >> 2) * 16} AS v{q}" for q, c in enumerate(t)) + " FROM cell" for k, t in enumerate(_SIX)) + ")"


@query(_TETS + ", s AS (" + " UNION ALL ".join(f"SELECT tid, {n} AS face, list_sort([{', '.join(f'v{m}' for m in range(4) if m != n)}]) AS key FROM tet" for n in range(4)) + """)
SELECT a.tid, a.face, b.tid AS neighbour FROM s a LEFT JOIN s b ON a.key = b.key AND a.tid <> b.tid""")
def tet_face_adjacency(spark, sf_dir):
    return mesh.face_adjacency(cube_mesh(spark)[1])


def _mesh_points(spark, sf_dir):
    return customer_points(spark, sf_dir).select("point_id", *((F.col(p) / 4.0).alias(p) for p in "xyz"))


@query("WITH " + _POINTS + """ SELECT point_id, CASE WHEN x <= 12 AND y <= 12 AND z <= 12 THEN round(x / 4 * 2 - y / 4, 6) + 0e0 END AS u, CASE WHEN x <= 12 THEN round(z / 4 + 1, 6) END AS v, CASE WHEN x <= 12 THEN round(x / 4 + y / 4 + z / 4, 6) END AS w FROM p""")
def barycentric(spark, sf_dir):
    vertices, tets = cube_mesh(spark)
    values = vertices.select("vid", (F.col("x") * 2 - F.col("y")).alias("u"), (F.col("z") + 1).alias("v"), (F.col("x") + F.col("y") + F.col("z")).alias("w"))
    return mesh.sample_tets(_mesh_points(spark, sf_dir), tets, vertices, values).select("point_id", r6("u"), F.round("v", 6).alias("v"), F.round("w", 6).alias("w"))


@query(_TETS + " SELECT tid, 1e0 / 6e0 AS volume FROM tet")
def tet_volumes(spark, sf_dir):
    vertices, tets = cube_mesh(spark)
    return mesh.with_corners(tets, vertices).select("tid", F.abs(mesh.tet_volume()).alias("volume"))


def amr_blocks(spark: SparkSession) -> DataFrame:
    """Three levels of blocks over 12^3: 27 blocks of side 4, refined where x < 8, and again where x < 4;
    raw levels are 2, 5 and 9, and each level's blocks have data where they are leaves, at some of 12 steps."""
    parts = []
    for level, side, lo, hi in ((2, 4, 8, 12), (5, 2, 4, 8), (9, 1, 0, 4)):
        n, m = (hi - lo) // side, 12 // side
        ids = F.col("id")
        c = (ids % n, F.floor(ids / n) % m, F.floor(ids / (n * m)))
        base = spark.range(n * m * m).select(F.lit(level).alias("level"), ids.alias("idx"), *((F.lit(float(lo if p == "x" else 0)) + v * float(side) + e).cast("double").alias(f"{p}{s}") for p, v in zip("xyz", c, strict=True) for s, e in (("min", 0.0), ("max", float(side)))))
        parts.append(base)
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return out.withColumn("has_data", (F.col("idx") + F.col("t")) % 5 != 0)


_AMR = "WITH b AS (" + " UNION ALL ".join(
    f"SELECT {level} AS level, id AS idx, {lo}e0 + id % {(hi - lo) // side} * {side}e0 AS xmin, {lo}e0 + id % {(hi - lo) // side} * {side}e0 + {side} AS xmax, "
    f"(id // {(hi - lo) // side}) % {12 // side} * {side}e0 AS ymin, (id // {(hi - lo) // side}) % {12 // side} * {side}e0 + {side} AS ymax, "
    f"id // {(hi - lo) // side * (12 // side)} * {side}e0 AS zmin, id // {(hi - lo) // side * (12 // side)} * {side}e0 + {side} AS zmax FROM range({(hi - lo) // side * (12 // side) ** 2}) r(id)"
    for level, side, lo, hi in ((2, 4, 8, 12), (5, 2, 4, 8), (9, 1, 0, 4))) + "), a AS (SELECT b.*, CAST(t AS INTEGER) AS t, (idx + t) % 5 <> 0 AS has_data FROM b, range(12) r(t))"


@query(_AMR + " SELECT CAST(dense_rank() OVER (ORDER BY level) - 1 AS INTEGER) AS level, idx, t FROM a")
def amr_dense_levels(spark, sf_dir):
    return amr.dense_levels(amr_blocks(spark)).select("level", "idx", "t")


@query(_AMR + " SELECT level, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax, min(xmax - xmin) AS size_x, count(*) AS n_blocks FROM a GROUP BY level")
def amr_level_bounds(spark, sf_dir):
    return amr.level_bounds(amr_blocks(spark)).select("level", "xmin", "xmax", "ymin", "ymax", "size_x", "n_blocks")


@query(_AMR + ", " + _POINTS + """, h AS (SELECT point_id, level, idx FROM p JOIN a ON t = 3 AND has_data AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax AND z BETWEEN zmin AND zmax),
g AS (SELECT point_id, min((-level, idx)) AS m FROM h GROUP BY 1) SELECT point_id, h.level, h.idx FROM p LEFT JOIN g USING (point_id) LEFT JOIN h USING (point_id) WHERE h.level IS NULL OR (-h.level, h.idx) = g.m""")
def amr_finest(spark, sf_dir):
    return amr.finest_block(customer_points(spark, sf_dir), amr_blocks(spark).where("t = 3").drop("t")).select("point_id", "level", "idx")


@query(_AMR + """, d AS (SELECT level, idx, t, t - row_number() OVER (PARTITION BY level, idx ORDER BY t) AS g FROM a WHERE has_data), e AS (SELECT *, dense_rank() OVER (PARTITION BY level, idx ORDER BY g) AS run, (row_number() OVER (PARTITION BY level, idx, g ORDER BY t) - 1) // 3 AS segment FROM d)
SELECT level, idx, CAST(run AS INTEGER) AS run, CAST(segment AS INTEGER) AS segment, min(t) AS tmin, max(t) AS tmax FROM e GROUP BY ALL""")
def amr_runs(spark, sf_dir):
    return amr.time_runs(amr_blocks(spark), 3)


@query(_AMR + " SELECT a.level, a.idx, b.level AS other_level, b.idx AS other_idx FROM a JOIN a b ON a.t = 1 AND b.t = 1 AND a.has_data AND b.has_data AND (a.level <> b.level OR a.idx <> b.idx) AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin AND a.zmin <= b.zmax AND a.zmax >= b.zmin")
def amr_touching(spark, sf_dir):
    return amr.touching(amr_blocks(spark).where("t = 1").drop("t"))


@query(_AMR + " SELECT level, idx, t FROM a WHERE has_data AND xmin <= 6 AND xmax >= 3 AND ymin <= 5 AND ymax >= 2 AND zmin <= 4 AND zmax >= 1")
def amr_region(spark, sf_dir):
    return amr.region(amr_blocks(spark), (3, 2, 1), (6, 5, 4)).select("level", "idx", "t")


# --- traces ------------------------------------------------------------------------------------


def _seeds(spark, sf_dir):
    return customer_points(spark, sf_dir).select(F.col("point_id").alias("seed_id"), "x", "y", "z")


def _small_box_seeds(spark, sf_dir):
    return customer_points(spark, sf_dir).select(F.col("point_id").alias("seed_id"), *((F.col(p) / 3).alias(p) for p in "xyz"))


def _linear_rk(order: str) -> str:
    """Rigid rotation u = -(y - 8) / 5, v = (x - 8) / 5 has an exact polynomial step."""
    f = lambda x, y: (f"(-0.2e0 * ({y} - 8e0))", f"(0.2e0 * ({x} - 8e0))")
    k1 = f("x", "y")
    if order == "rk2":
        k2 = f(f"(x + 0.25e0 * {k1[0]})", f"(y + 0.25e0 * {k1[1]})")
        new = [f"{c} + 0.25e0 * ({a} + {b}) / 2e0" for c, a, b in zip("xy", k1, k2, strict=True)]
    else:
        k2 = f(f"(x + 0.125e0 * {k1[0]})", f"(y + 0.125e0 * {k1[1]})")
        k3 = f(f"(x + 0.125e0 * {k2[0]})", f"(y + 0.125e0 * {k2[1]})")
        k4 = f(f"(x + 0.25e0 * {k3[0]})", f"(y + 0.25e0 * {k3[1]})")
        new = [f"{c} + 0.25e0 * ({a} + 2e0 * {b} + 2e0 * {d} + {e}) / 6e0" for c, a, b, d, e in zip("xy", k1, k2, k3, k4, strict=True)]
    return f"""WITH RECURSIVE s AS (SELECT id AS seed_id, 0 AS seq, 9e0 + CAST(id AS DOUBLE) / 7e0 AS x, 8e0 AS y FROM range(40) r(id)
UNION ALL SELECT seed_id, seq + 1, {new[0]}, {new[1]} FROM s WHERE seq < 24) SELECT seed_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM s"""


def _rotation_seeds(spark):
    return spark.range(40).select(F.col("id").alias("seed_id"), (9.0 + F.col("id") / 7.0).alias("x"), F.lit(8.0).alias("y"), F.lit(2.0).alias("z"))


def _fixed(spark, order):
    got = tracing.streamlines(rotation_field(spark), _rotation_seeds(spark), Direction.FORWARD, Integration(order=order).fixed(0.25), 25)
    return got.select("seed_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_linear_rk("rk2"))
def rk2_fixed(spark, sf_dir):
    return _fixed(spark, Order.SECOND)


@query(_linear_rk("rk4"))
def rk4_fixed(spark, sf_dir):
    return _fixed(spark, Order.FOURTH)


@query()
def streamlines_rk45(spark, sf_dir):
    return tracing.streamlines(lineitem_field(spark, sf_dir), _seeds(spark, sf_dir), max_points=200, emit_empty=True)


@query()
def streamlines_merged(spark, sf_dir):
    return tracing.merged_streamlines(lineitem_field(spark, sf_dir), _seeds(spark, sf_dir), max_points=100)


@query()
def pathlines_rk4(spark, sf_dir):
    seeds = customer_points(spark, sf_dir, t=True).select(F.col("point_id").alias("seed_id"), *((F.col(p) / 3).alias(p) for p in "xyz"), F.least("t", F.lit(8.0)).alias("t"))
    return tracing.pathlines(events_field(spark, sf_dir), seeds, options=Integration(order=Order.FOURTH).fixed(0.25), max_points=60)


@query()
def pathlines_by_blocks(spark, sf_dir):
    seeds = customer_points(spark, sf_dir, t=True).select(F.col("point_id").alias("seed_id"), *((F.col(p) / 3).alias(p) for p in "xyz"), F.lit(0.0).alias("t"))
    got = rounds.trace_by_blocks(events_field(spark, sf_dir), seeds, 4, Integration(order=Order.FOURTH).fixed(0.25), 40, time_blocks=3)
    return rounds.stitch(got)


@query()
def hand_off_matrix(spark, sf_dir):
    got = rounds.trace_by_blocks(lineitem_field(spark, sf_dir), _seeds(spark, sf_dir), 8, Integration(order=Order.FOURTH).fixed(0.05), 60, ghost=2)
    return aggregate.flow_matrix(rounds.hand_offs(got))


@query()
def streaklines(spark, sf_dir):
    return fronts.streaklines(events_field(spark, sf_dir), _small_box_seeds(spark, sf_dir), 1.0)


@query()
def timelines(spark, sf_dir):
    return fronts.timelines(events_field(spark, sf_dir), _small_box_seeds(spark, sf_dir), 1.0, delay=3)


@query()
def uncertain_streamlines(spark, sf_dir):
    field = lineitem_field(spark, sf_dir)
    field = field.with_nodes(field.nodes.withColumns({f"s{c}": F.abs(c) / 10.0 for c in "uvw"}))
    return tracing.uncertain_streamlines(field, _seeds(spark, sf_dir), 5, 3, direction=Direction.FORWARD, options=Integration(order=Order.FOURTH).fixed(0.25), max_points=20)


@query()
def streamline_metrics(spark, sf_dir):
    field = lineitem_field(spark, sf_dir)
    seeds = seeding.regular_seeds(spark, (1, 1, 1), (10, 10, 5), [4, 4, 3])
    return derive.trace_metrics(tracing.streamlines(field, seeds, Direction.FORWARD, max_points=30).drop("status"), field)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamlines of the 6 x 6 x 7 lineitem field from a solid rake, summed up by seed."""
    field = lineitem_field(spark, sf_dir, 6)
    seeds = seeding.regular_seeds(spark, (1, 1, 1), (4, 4, 5), [5, 5, 4])
    points = tracing.streamlines(field, seeds, max_points=100)
    return points.groupBy("seed_id", "dir", "status").agg(F.count("*").alias("n_points"), *(f(p).alias(f"{p}{n}") for p in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))
