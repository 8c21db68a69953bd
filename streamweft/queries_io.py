"""Registered queries of the sources and sinks: a field, mesh or line table made from the test
tables is written into the shared folder in a file format and read back from there."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .field import FlowField
from .operators import blocks, lines, locate, mesh
from .plans.rounds import scratch_root, shared_table
from .queries import _BLOCKS, _EVENTS, _FIELD, _SAMPLED, _TETS, _blocks, customer_points, cube_mesh, events_field, lineitem_field, query, rotation_field
from .sources import binary, formats, lists

_N = ("t", "i", "j", "k", "u", "v", "w")


def _f32(*names: str) -> str:
    return ", ".join(f"CAST(CAST({n} AS FLOAT) AS DOUBLE) AS {n}" for n in names)


_SINGLE = f"t, i, j, k, {_f32('u', 'v', 'w')}"


def folder(spark: SparkSession) -> str:
    """A fresh local path below the shared folder."""
    path = os.path.join(scratch_root(spark).removeprefix("file://"), f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _field(spark: SparkSession, sf_dir: str) -> FlowField:
    field = lineitem_field(spark, sf_dir)
    return field.with_nodes(shared_table(field.nodes, "field"))


def _vec(spark: SparkSession, sf_dir: str) -> tuple[FlowField, str]:
    field, path = _field(spark, sf_dir), folder(spark) + "/a.vec"
    binary.write_vec(field, path)
    return field, path


# --- dense binary fields ---------------------------------------------------------


@query(_FIELD + f" SELECT {_SINGLE} FROM f")
def source_vec(spark, sf_dir):
    return binary.read_vec(spark, _vec(spark, sf_dir)[1]).nodes


@query(_FIELD + f" SELECT {_SINGLE} FROM f")
def source_raw(spark, sf_dir):
    path = _vec(spark, sf_dir)[1]
    dims = binary.vec_to_raw(path, path[:-4] + ".raw")
    return binary.read_vec(spark, path[:-4] + ".raw", dims).nodes


@query(_FIELD + f" SELECT {_SINGLE} FROM f")
def convert_raw_to_vec(spark, sf_dir):
    path = _vec(spark, sf_dir)[1]
    dims = binary.vec_to_raw(path, path[:-4] + ".raw")
    binary.raw_to_vec(path[:-4] + ".raw", path[:-4] + "_b.vec", dims)
    return binary.read_vec(spark, path[:-4] + "_b.vec").nodes


@query(_FIELD + f" SELECT t, CAST(i - 2 AS INTEGER) AS i, CAST(j - 3 AS INTEGER) AS j, CAST(k - 1 AS INTEGER) AS k, {_f32('u', 'v', 'w')} FROM f WHERE i BETWEEN 2 AND 9 AND j BETWEEN 3 AND 7 AND k BETWEEN 1 AND 4")
def source_box(spark, sf_dir):
    return binary.read_vec(spark, _vec(spark, sf_dir)[1], lo=(2, 3, 1), hi=(9, 7, 4)).nodes


@query(_FIELD + f" SELECT {_SINGLE} FROM f WHERE k = 2 AND j >= 4 AND i < 7")
def source_pushdown(spark, sf_dir):
    return binary.read_vec(spark, _vec(spark, sf_dir)[1]).nodes.where("k = 2 AND j >= 4 AND i < 7")


@query(_FIELD + f" SELECT {_SINGLE} FROM f")
def source_big_endian(spark, sf_dir):
    path = _vec(spark, sf_dir)[1]
    with open(path, "rb") as a, open(path + ".be", "wb") as b:
        b.write(binary.swap_bytes(a.read(), 4))
    return binary.read_vec(spark, path + ".be", endian=">").nodes


def _series(spark: SparkSession, sf_dir: str, head: str) -> str:
    """Ten step files and a list that names them after ``head``."""
    field, at = events_field(spark, sf_dir), folder(spark)
    field = field.with_nodes(shared_table(field.nodes, "field"))
    for t in range(10):
        binary.write_vec(field, f"{at}/{t}.vec", with_header="5 5" not in head, t=t)
    with open(f"{at}/list", "w", encoding="ascii") as f:
        f.write(head + "\n" + "\n".join(f"{t}.vec" for t in range(10)) + "\n")
    return f"{at}/list"


@query(_EVENTS + f" SELECT {_SINGLE} FROM f")
def source_series(spark, sf_dir):
    return binary.read_series(spark, lists.read_list(_series(spark, sf_dir, "10 # steps"))).nodes


@query(_EVENTS + f" SELECT {_SINGLE} FROM f WHERE t <> 4")
def source_series_missing_step(spark, sf_dir):
    path = _series(spark, sf_dir, "10")
    os.remove(os.path.dirname(path) + "/4.vec")
    return binary.read_series(spark, lists.read_list(path)).nodes


@query(_EVENTS + f" SELECT t, CAST(i - 1 AS INTEGER) AS i, j, CAST(k - 2 AS INTEGER) AS k, {_f32('u', 'v', 'w')} FROM f WHERE t BETWEEN 2 AND 5 AND i BETWEEN 1 AND 3 AND k BETWEEN 2 AND 4")
def source_series_window(spark, sf_dir):
    return binary.read_series(spark, lists.read_list(_series(spark, sf_dir, "10 5 5 5")), (1, 0, 2), (3, 4, 4), 2, 5).nodes


@query(_EVENTS + f" SELECT {_SINGLE} FROM f WHERE t BETWEEN 4 AND 7")
def source_time_group(spark, sf_dir):
    return binary.read_series(spark, lists.read_list(_series(spark, sf_dir, "10"))).nodes.where("t >= 4 AND t <= 7")


@query(_EVENTS + " SELECT t, i, j, k, " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) * 2.5e0 AS {c}" for c in "uvw") + " FROM f")
def source_parallel_list(spark, sf_dir):
    return binary.read_series(spark, lists.read_parallel_list(_series(spark, sf_dir, "5 5 5 10 # dims\n2.5 # scale"))).nodes


@query(_EVENTS + f" SELECT 'RAW' AS mode, {_SINGLE} FROM f UNION ALL SELECT 'RAW_HEADER', {_SINGLE} FROM f UNION ALL SELECT 'NETCDF', {_SINGLE} FROM f WHERE t = 0")
def source_by_mode(spark, sf_dir):
    at = folder(spark) + "/f.nc"
    formats.write_netcdf(events_field(spark, sf_dir), at)
    out = None
    for mode, path, options in (("RAW", _series(spark, sf_dir, "10 5 5 5"), {}), ("RAW_HEADER", _series(spark, sf_dir, "10"), {}), ("NETCDF", at, {"names": ["u", "v", "w"]})):
        nodes = formats.read_field(spark, path, mode, **options).nodes.select(F.lit(mode).alias("mode"), *_N)
        out = nodes if out is None else out.unionByName(nodes)
    return out


@query(_FIELD + " SELECT t, i, j, k, CAST(CAST(u AS FLOAT) AS DOUBLE) AS u, 0e0 AS v, CASE WHEN w = 0 THEN 0e0 ELSE CAST(CAST(w AS FLOAT) AS DOUBLE) END AS w FROM f")
def source_netcdf(spark, sf_dir):
    path = folder(spark) + "/f.nc"
    formats.write_netcdf(_field(spark, sf_dir), path)
    return formats.read_netcdf_field(spark, path, ["u", None, "w"], (None, None, 0.0)).nodes


@query(_FIELD + f" SELECT t, i, j, k, {_f32('u', 'v', 'w')}, CAST(CAST(abs(u) AS FLOAT) AS DOUBLE) AS su, CAST(CAST(abs(v) AS FLOAT) AS DOUBLE) AS sv, CAST(CAST(abs(w) AS FLOAT) AS DOUBLE) AS sw FROM f")
def source_gaussian(spark, sf_dir):
    field, path = _vec(spark, sf_dir)
    binary.write_vec(field.with_nodes(field.nodes.withColumns({c: F.abs(c) for c in "uvw"})), path + ".std")
    return binary.read_gaussian(spark, path, path + ".std").nodes


@query("SELECT CAST(0 AS INTEGER) AS t, CAST(id % 17 AS INTEGER) AS i, CAST(id // 17 % 17 AS INTEGER) AS j, CAST(id // 289 AS INTEGER) AS k, round(-(CAST(id // 17 % 17 AS DOUBLE) - 8) * 0.2e0, 9) + 0e0 AS u, round((CAST(id % 17 AS DOUBLE) - 8) * 0.2e0, 9) + 0e0 AS v, 0e0 AS w FROM range(1445) r(id)")
def field_from_memory(spark, sf_dir):
    return rotation_field(spark).nodes.select("t", "i", "j", "k", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in "uvw"))


# --- curvilinear grids, meshes -------------------------------------------------------


def _plot3d(spark: SparkSession, sf_dir: str) -> str:
    """``.soln`` (density 2, and 0 at k = 0) and ``.grid`` (x = i + j / 2, y = 2 j, z = k / 4) of the lineitem field."""
    v, base = _field(spark, sf_dir).to_numpy()[0], folder(spark) + "/a"
    nz, ny, nx, _ = v.shape
    k, j, i = np.indices((nz, ny, nx)).astype("<f4")
    rho = np.where(k == 0, 0, 2).astype("<f4")
    planes = [rho, *(v[..., c].astype("<f4") * 2 for c in range(3)), rho]
    head = np.array([nx, ny, nz], "<i4").tobytes()
    with open(f"{base}.soln", "wb") as f:
        f.write(head + np.zeros(4, "<f4").tobytes() + b"".join(p.astype("<f4").tobytes() for p in planes))
    with open(f"{base}.grid", "wb") as f:
        f.write(head + b"".join(p.astype("<f4").tobytes() for p in (i + j / 2, 2 * j, k / 4)))
    return base


_MASS = ", ".join(f"CASE WHEN k = 0 THEN 0e0 ELSE CAST(CAST({c} AS FLOAT) AS DOUBLE) END AS {c}" for c in "uvw")


@query(_FIELD + f" SELECT t, i, j, k, {_MASS} FROM f")
def source_plot3d_solution(spark, sf_dir):
    return formats.read_plot3d_solution(spark, _plot3d(spark, sf_dir) + ".soln").nodes


@query(_FIELD + " SELECT i, j, k, i + j / 2e0 AS x, 2e0 * j AS y, k / 4e0 AS z FROM f")
def source_plot3d_grid(spark, sf_dir):
    return formats.read_plot3d_grid(spark, _plot3d(spark, sf_dir) + ".grid")[0]


@query(_FIELD + f" SELECT i, j, k, {_MASS}, i + j / 2e0 AS x, 2e0 * j AS y, k / 4e0 AS z FROM f")
def source_curvilinear_base(spark, sf_dir):
    field, vertices, _ = formats.load_base(spark, _plot3d(spark, sf_dir), "curvilinear")
    return field.nodes.drop("t").join(vertices, ["i", "j", "k"])


@query(_TETS + ", v AS (SELECT id AS vid, CAST(id % 4 AS DOUBLE) AS x, CAST(id // 4 % 4 AS DOUBLE) AS y, CAST(id // 16 AS DOUBLE) AS z FROM range(64) r(id)) SELECT tid, v0, v1, v2, v3, x AS x0, y AS y0, z AS z0 FROM tet JOIN v ON vid = v0")
def source_tet_mesh(spark, sf_dir):
    vertices, tets = cube_mesh(spark)
    at = folder(spark)
    p = np.array(vertices.orderBy("vid").select("x", "y", "z").collect(), "<f4")
    q = np.array(tets.orderBy("tid").select("v0", "v1", "v2", "v3").collect(), "<i4")
    with open(f"{at}/m.grid", "wb") as f:
        f.write(np.array([len(p), 0, len(q)], "<i4").tobytes() + p.T.tobytes())
    q.tofile(f"{at}/m.tetra")
    found, cells = formats.read_tet_mesh(spark, f"{at}/m.grid", f"{at}/m.tetra")
    return mesh.with_corners(cells, found).select("tid", "v0", "v1", "v2", "v3", "x0", "y0", "z0")


@query(_FIELD + " SELECT t, i, j, k, u, v, w FROM f")
def source_vtk(spark, sf_dir):
    path = folder(spark) + "/f.vtk"
    formats.write_vtk(_field(spark, sf_dir), path)
    return formats.read_vtk(spark, path).nodes


@query(_FIELD + " SELECT t, i, j, k, u, v, w FROM f")
def source_vti(spark, sf_dir):
    path = folder(spark) + "/f.vti"
    formats.write_vti(_field(spark, sf_dir), path)
    return formats.read_vti(spark, path).nodes


@query(_FIELD + " SELECT i, j, k, u, v, w, i + 0.5e0 * j AS x, 2e0 * j AS y, 0.25e0 * k AS z FROM f")
def source_vts(spark, sf_dir):
    field, path = _field(spark, sf_dir), folder(spark) + "/f.vts"
    formats.write_vts(field, field.nodes.select("i", "j", "k", (F.col("i") + 0.5 * F.col("j")).alias("x"), (F.col("j") * 2.0).alias("y"), (F.col("k") * 0.25).alias("z")), path)
    again, vertices = formats.read_vts(spark, path)
    return again.nodes.drop("t").join(vertices, ["i", "j", "k"])


# --- seeds, partitions, lines ----------------------------------------------------------


@query("SELECT id AS seed_id, 1e0 + id / 8e0 AS x, 2e0 AS y, CAST(id % 5 AS DOUBLE) AS z FROM range(300) r(id)")
def source_seed_file(spark, sf_dir):
    path = folder(spark) + "/seeds"
    with open(path, "w", encoding="ascii") as f:
        f.write("300\n" + "".join(f"{1 + n / 8} 2 {n % 5}\n" for n in range(300)))
    return lists.read_seed_file(spark, path)


_EIGHT = ", ".join(f"real_{s}_{p} AS {s}_{p}" for s in ("lo", "hi") for p in "xyzt")


@query(_BLOCKS + f" SELECT gid, CAST(gid % 5 AS INTEGER) AS proc, {', '.join(f'CAST(real_{s}_{p} AS INTEGER) AS {s}_{p}' for s in ('lo', 'hi') for p in 'xyzt')} FROM b")
def source_partition_file(spark, sf_dir):
    path = folder(spark) + "/part"
    names = [f"real_{s}_{p}" for s in ("lo", "hi") for p in "xyzt"]
    rows = blocks.assign_round_robin(_blocks(spark), 5).select("gid", "proc", *names).orderBy("gid").collect()  # 24 blocks
    formats.write_partition(path, (12, 12, 7, 10), 5, 2, (3, 5, 3, 4), [tuple(r) for r in rows])
    return formats.read_partition(spark, path)


def customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of one to five points for every customer; all numbers are exact in single precision."""
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("seed_id"), F.lit(1).alias("dir"), F.explode(F.sequence(F.lit(0), (key % 5).cast("int"))).alias("seq"))
    return rows.select("seed_id", "dir", "seq", F.col("seed_id").cast("double").alias("x"), (F.col("seq") * 2.0).alias("y"), F.lit(0.5).alias("z"), F.col("seq").cast("double").alias("t"))


_CUSTOMER_LINES = "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS line FROM customer), l AS (SELECT c_custkey, line, CAST(n AS INTEGER) AS seq FROM c, range(5) r(n) WHERE n <= c_custkey % 5)"


@query(_CUSTOMER_LINES + " SELECT line AS seed_id, seq, CAST(c_custkey AS DOUBLE) AS x, seq * 2e0 AS y, 0.5e0 AS z, CAST(seq AS DOUBLE) AS t FROM l")
def trajectory_file(spark, sf_dir):
    path = folder(spark) + "/lines"
    formats.write_trajectories(customer_lines(spark, sf_dir), path, (0,) * 4, (9,) * 4, path + ".ids")
    return formats.read_trajectories(spark, path)


@query(_CUSTOMER_LINES + " SELECT line, c_custkey AS seed_id FROM c")
def trajectory_seed_ids(spark, sf_dir):
    path = folder(spark) + "/lines"
    formats.write_trajectories(customer_lines(spark, sf_dir), path, (0,) * 4, (9,) * 4, path + ".ids")
    ids = spark.read.format("binaryFile").load(f"file://{path}.ids").select("content")
    n = F.octet_length("content") / 8
    each = ids.select("content", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("line"))
    byte = lambda b: F.conv(F.hex(F.substring("content", F.col("line") * 8 + b + 1, F.lit(1))), 16, 10).cast("long")
    return each.select(F.col("line").cast("long").alias("line"), sum((byte(b) * (1 << 8 * b) for b in range(1, 7)), byte(0)).alias("seed_id"))


@query(_CUSTOMER_LINES + " SELECT line AS seed_id, seq, CAST(c_custkey AS DOUBLE) AS x, seq * 2e0 AS y, 0.5e0 AS z, CAST(seq AS DOUBLE) AS t FROM l")
def nan_separated_lines(spark, sf_dir):
    rows = customer_lines(spark, sf_dir)
    nan = F.lit(float("nan"))
    ends = rows.select("seed_id").distinct().select((F.col("seed_id") * 10 + 9).alias("n"), *(nan.alias(c) for c in "xyzt"))
    return lines.nan_separated(rows.select((F.col("seed_id") * 10 + F.col("seq")).alias("n"), "x", "y", "z", "t").unionByName(ends))


@query(_CUSTOMER_LINES + " SELECT c_custkey AS seed_id, 1 AS dir, CAST(c_custkey % 5 + 1 AS BIGINT) AS n_points FROM c")
def trace_counts(spark, sf_dir):
    from .operators import aggregate

    return aggregate.trace_counts(customer_lines(spark, sf_dir))


@query(_FIELD + f" SELECT i, j, k, {_f32('u')} FROM f")
def volume_file(spark, sf_dir):
    field, path = _field(spark, sf_dir), folder(spark) + "/u"
    formats.write_volume(field.nodes, field.dims, "u", path)
    return formats.read_volume(spark, path, "u")


@query(_SAMPLED + " SELECT point_id AS seed_id, 1 AS dir, 0 AS seq, round(sqrt(u * u + v * v + w * w), 6) + 0e0 AS speed FROM p LEFT JOIN m USING (point_id)")
def line_speed(spark, sf_dir):
    points = customer_points(spark, sf_dir).select(F.col("point_id").alias("seed_id"), F.lit(1).alias("dir"), F.lit(0).alias("seq"), "x", "y", "z")
    return lines.with_speed(points, lineitem_field(spark, sf_dir)).select("seed_id", "dir", "seq", (F.round("speed", 6) + F.lit(0.0)).alias("speed"))


@query(_FIELD + " SELECT t, i, j, k, u, v, w FROM f")
def parquet_container(spark, sf_dir):
    return shared_table(lineitem_field(spark, sf_dir).nodes, "container")


@query("SELECT CAST(id AS INTEGER) AS i, CAST(i2 AS INTEGER) AS j, CAST(i3 AS INTEGER) AS k, CASE WHEN id < 12 AND i2 < 12 AND i3 < 7 THEN CAST(id AS DOUBLE) END AS x, CASE WHEN id < 12 AND i2 < 12 AND i3 < 7 THEN CAST(i2 AS DOUBLE) END AS y, CASE WHEN id < 12 AND i2 < 12 AND i3 < 7 THEN CAST(i3 AS DOUBLE) END AS z FROM range(13) a(id), range(13) b(i2), range(8) c(i3)")
def vertex_positions(spark, sf_dir):
    n = F.col("id")
    rows = spark.range(13 * 13 * 8).select((n % 13).cast("int").alias("i"), (F.floor(n / 13) % 13).cast("int").alias("j"), F.floor(n / 169).cast("int").alias("k"))
    return locate.vertex_position(rows, lineitem_field(spark, sf_dir))
