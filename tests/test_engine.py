"""Analytic fields, invariances and codecs."""

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamweft.field import FlowField
from streamweft.operators import aggregate, blocks, derive, isosurface, lines, locate, mesh, seeding, transform
from streamweft.plans import fronts, kernel, rounds, tracing
from streamweft.schema import Axis, Direction, Integration, Order
from streamweft.sources import binary, formats, lists

RK4 = Integration(order=Order.FOURTH)


def lattice(n=9, nz=5):
    k, j, i = np.indices((nz, n, n)).astype(float)
    return i, j, k


def rotation(spark, n=17, nz=5, speed=0.2):
    i, j, k = lattice(n, nz)
    c = (n - 1) / 2
    return FlowField.from_numpy(spark, np.stack([-(j - c) * speed, (i - c) * speed, 0 * i], -1))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def seeds_of(spark, points, t=None):
    data = [(n, *map(float, p)) for n, p in enumerate(points)]
    df = spark.createDataFrame(data, "seed_id long, x double, y double, z double")
    return df if t is None else df.withColumn("t", F.lit(float(t)))


def test_rotation_has_known_derivatives(spark):
    field = rotation(spark, 9)
    got = derive.vortex_metrics(derive.gradient_scalars(derive.jacobian_nodes(field)))
    for q, delta, lam, div, gamma in rows(got, "q", "delta", "lambda2", "divergence", "gamma2"):
        assert q == pytest.approx(0.04) and lam == pytest.approx(-0.04) and div == pytest.approx(0)
        assert delta == pytest.approx((0.04 / 3) ** 3) and gamma is None
    assert all(w == pytest.approx(0.4) and u == v == 0 for u, v, w in rows(derive.vorticity(field).nodes, "u", "v", "w"))
    assert all(w == pytest.approx(1) for (w,) in rows(derive.vorticity(field, normalize=True).nodes, "w"))


def test_laplacian_of_squares(spark):
    i, j, k = lattice(6, 6)
    field = FlowField.from_numpy(spark, np.stack([i**2, j**2, k**2], -1))
    for i_, j_, k_, u, v, w in rows(derive.laplacian(field).nodes, "i", "j", "k", "u", "v", "w"):
        want = 2.0 if all(0 < c < 5 for c in (i_, j_, k_)) else 0.0
        assert (u, v, w) == (want,) * 3


def test_curl_and_gradient_at_points(spark):
    i, j, k = lattice(6, 6)
    field = FlowField.from_numpy(spark, np.stack([k, 2 * i, 3 * j], -1))
    p = spark.createDataFrame([(1, 2.5, 2.5, 2.5), (2, 0.0, 0.0, 0.0), (3, 9.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    got = {r.point_id: r for r in derive.jacobian_at(p, field).collect()}
    assert [got[1][f"j{r}{c}"] for r in range(3) for c in range(3)] == pytest.approx([0, 0, 1, 2, 0, 0, 0, 3, 0])
    assert got[2].j02 == pytest.approx(1) and got[3].j02 is None
    curl = {r.point_id: r for r in derive.curl_at(p, field).collect()}
    assert (curl[1].curl_x, curl[1].curl_y, curl[1].curl_z) == pytest.approx((3, 1, 2))


def test_sampling_is_exact_for_trilinear_fields(spark):
    i, j, k = lattice(5, 5)
    values = np.stack([np.stack([i * j * k + t, i + j, k * 0 + t], -1) for t in range(3)])
    field = FlowField.from_numpy(spark, values)
    p = spark.createDataFrame([(1, 1.5, 2.25, 3.5, 0.5), (2, 4.0, 4.0, 4.0, 2.0), (3, -0.1, 0.0, 0.0, 0.0), (4, 1.0, 1.0, 1.0, 2.5)], "point_id long, x double, y double, z double, t double")
    got = {r.point_id: (r.u, r.v, r.w) for r in locate.sample(p, field).collect()}
    assert got[1] == pytest.approx((1.5 * 2.25 * 3.5 + 0.5, 3.75, 0.5)) and got[2] == pytest.approx((66, 8, 2))
    assert got[3] == got[4] == (None, None, None)


@pytest.mark.parametrize("order,power", [(Order.SECOND, 2), (Order.FOURTH, 4), (Order.RK45, 5)])
def test_order_of_convergence(order, power):
    def sample(p, t, row):
        return np.stack([-p[:, 1], p[:, 0], 0 * p[:, 0]], 1), np.ones(len(p), bool)

    errors = []
    for n in (16, 32):
        p, t = np.array([[1.0, 0.0, 0.0]]), np.zeros(1)
        for _ in range(n):
            p, ok, _ = kernel.step(sample, order, p, t, np.full(1, 2 / n), np.ones(1), np.zeros(1, int))
        errors.append(np.linalg.norm(p - [[math.cos(2), math.sin(2), 0]]))
    assert math.log2(errors[0] / errors[1]) > power - 0.4


def test_streamlines_keep_the_radius_and_report_status(spark):
    field = rotation(spark)
    seeds = seeds_of(spark, [(12, 8, 2), (8, 8, 2), (30, 8, 2)])
    got = tracing.streamlines(field, seeds, Direction.BOTH, Integration(max_error=1e-6, max_step=0.5), 60, emit_empty=True)
    for x, y in rows(got.where("seed_id = 0"), "x", "y"):
        assert math.hypot(x - 8, y - 8) == pytest.approx(4, abs=1e-3)
    empty = {(r.seed_id, r.status) for r in got.where("seq IS NULL").collect()}
    assert empty == {(1, "CRITICAL"), (2, "OUT_OF_BOUND")}
    merged = tracing.merge_directions(got)
    assert merged.count() == got.where("seq IS NOT NULL").count() - 1
    assert {r.status for r in got.where("seed_id = 0").collect()} == {"MAX_POINTS"}


def test_uniform_flow_is_straight_and_ends_outside(spark):
    field = FlowField.from_numpy(spark, np.ones((5, 5, 5, 3)) * [1.0, 0.0, 0.0])
    got = tracing.streamlines(field, seeds_of(spark, [(1, 2, 2)]), Direction.FORWARD, RK4.fixed(0.5), 100).orderBy("seq").collect()
    assert [r.x for r in got] == [1 + 0.5 * n for n in range(7)] and {(r.y, r.z) for r in got} == {(2.0, 2.0)} and got[-1].status == "OKAY"
    line = tracing.infinite_lines(field, seeds_of(spark, [(1, 2, 2)]), RK4.fixed(0.3)).orderBy("seq").collect()
    assert line[-1].x == pytest.approx(4.0) and line[-1].status == "OUT_OF_BOUND"


def test_pathline_of_a_pulsating_flow(spark):
    values = np.stack([np.ones((3, 3, 40, 3)) * [t + 1.0, 0, 0] for t in range(4)])
    field = FlowField.from_numpy(spark, values)
    got = tracing.pathlines(field, seeds_of(spark, [(1, 1, 1)], 0.0), options=RK4.fixed(0.25), max_points=9).orderBy("t").collect()
    assert all(r.x == pytest.approx(1 + r.t + r.t**2 / 2) for r in got) and got[-1].t == pytest.approx(2)


def test_forward_then_backward_returns(spark):
    field = rotation(spark)
    ahead = tracing.advect_interval(field, seeds_of(spark, [(12, 8, 2)]), 0, 1)
    back = tracing.advect_interval(field, ahead.select("seed_id", "x", "y", "z"), 1, 0).first()
    assert (back.x, back.y, back.z) == pytest.approx((12, 8, 2), abs=1e-4)


def test_blocks_give_the_same_lines(spark):
    field = rotation(spark)
    seeds = seeds_of(spark, [(9.1 + n, 8.3, 2.0) for n in range(5)])
    whole = tracing.streamlines(field, seeds, Direction.FORWARD, RK4.fixed(0.25), 60)
    parts = rounds.trace_by_blocks(field, seeds, 4, RK4.fixed(0.25), 60)
    a = {(r.seed_id, r.seq): (r.x, r.y) for r in whole.collect()}
    b = {(r.seed_id, r.seq): (r.x, r.y) for r in rounds.stitch(parts).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert rounds.hand_offs(parts).count() > 0


@pytest.mark.parametrize("options", [RK4.fixed(0.25), Integration(max_step=0.5), Integration(order=Order.FOURTH, max_step=0.5)])
def test_large_fields_are_traced_by_blocks(spark, monkeypatch, options):
    """Both ways give the same rows: directions, adaptive steps, statuses, seeds without a line."""
    field = rotation(spark)
    seeds = seeds_of(spark, [(9.1 + n, 8.3, 2.0) for n in range(5)] + [(8, 8, 2), (30, 8, 2), (15.9, 15.9, 2)])
    whole = tracing.streamlines(field, seeds, Direction.BOTH, options, 40, emit_empty=True)
    want = {(r.seed_id, r.dir, r.seq): r for r in whole.collect()}
    monkeypatch.setattr(tracing, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(tracing, "BLOCK_BYTES", field.size_bytes() // 4)
    monkeypatch.setattr(rounds, "CROWD", 2)
    got = {(r.seed_id, r.dir, r.seq): r for r in tracing.streamlines(field, seeds, Direction.BOTH, options, 40, emit_empty=True).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].status == r.status and (r.seq is None or (got[k].x, got[k].y, got[k].z) == pytest.approx((r.x, r.y, r.z), abs=1e-9)), k


def test_large_unsteady_fields_are_traced_by_blocks(spark, monkeypatch):
    values = np.stack([np.ones((3, 3, 40, 3)) * [t + 1.0, 0, 0] for t in range(4)])
    field = FlowField.from_numpy(spark, values)
    field = field.with_nodes(field.nodes.withColumn("t", F.col("t") + 2), t_range=(2, 5))
    seeds = seeds_of(spark, [(1 + n, 1, 1) for n in range(3)], 2.0)
    want = sorted(rows(tracing.pathlines(field, seeds, options=RK4.fixed(0.25), max_points=12), "seed_id", "seq", "t", "x", "status"))
    monkeypatch.setattr(tracing, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(tracing, "BLOCK_BYTES", field.size_bytes() // 3)
    got = sorted(rows(tracing.pathlines(field, seeds, options=RK4.fixed(0.25), max_points=12), "seed_id", "seq", "t", "x", "status"))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_rounds_never_end_silently(spark):
    field = FlowField.from_numpy(spark, np.ones((3, 3, 40, 3)) * [1.0, 0.0, 0.0])
    seeds = seeds_of(spark, [(1, 1, 1)])
    with pytest.raises(RuntimeError, match="still travel"):
        rounds.trace_by_blocks(field, seeds, 8, RK4.fixed(0.5), 100, max_rounds=2)
    with pytest.raises(Exception, match="ghost layers"):
        rounds.trace_by_blocks(field, seeds, 8, RK4.fixed(3.0), 100)
    assert rounds.trace_by_blocks(field, seeds, 8, RK4.fixed(3.0), 100, ghost=4).count() == 13


def test_repeated_and_null_keys_are_sampled_row_by_row(spark):
    field = rotation(spark)
    p = spark.createDataFrame([(1, 10.0, 8.0, 2.0), (1, 10.0, 8.0, 2.0), (1, 9.0, 8.0, 2.0), (None, 10.0, 8.0, 2.0), (2, 99.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    got = [(r.point_id, r.x, r.v if r.v is None else round(r.v, 9)) for r in locate.sample(p, field).collect()]
    assert sorted(got, key=str) == sorted([(1, 10.0, 0.4), (1, 10.0, 0.4), (1, 9.0, 0.2), (None, 10.0, 0.4), (2, 99.0, None)], key=str)
    for r in derive.curl_at(p, field).where("x < 50").collect() + derive.jacobian_at(p, field).where("x < 50").collect():
        assert (r.curl_z if "curl_z" in r else r.j10 - r.j01) == pytest.approx(0.4)


def test_iso_surfaces_keep_their_step(spark):
    i, j, k = lattice(4, 4)
    field = FlowField.from_numpy(spark, np.stack([np.stack([i + t, j, k], -1) for t in range(2)]))
    got = isosurface.iso_surface(field, "u", [1.5]).groupBy("t").agg(F.min("x0"), F.max("x0")).orderBy("t").collect()
    assert [tuple(r) for r in got] == [(0, 1.5, 1.5), (1, 0.5, 0.5)]


def test_field_files_by_mode_and_netcdf(spark, tmp_path):
    field = rotation(spark, 5, 3)
    formats.write_netcdf(field, str(tmp_path / "f.nc"))
    again = formats.read_field(spark, str(tmp_path / "f.nc"), "NETCDF", names=["u", "v", "w"])
    assert np.allclose(again.to_numpy(), field.to_numpy())
    binary.write_vec(field, str(tmp_path / "a.vec"))
    (tmp_path / "list").write_text("1\na.vec\n")
    assert np.allclose(formats.read_field(spark, str(tmp_path / "list"), "RAW_HEADER").to_numpy(), field.to_numpy())
    with pytest.raises(ValueError):
        formats.read_field(spark, str(tmp_path / "list"), "RAW")


def test_fragments_connect_exactly(spark):
    data = [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 5.0), (1, 1, 6.0), (2, 0, 1.0), (2, 1, 2.0), (3, 0, 2.0), (3, 1, 3.0), (4, 0, 3.0)]
    df = spark.createDataFrame([(f, s, x, 0.0, 0.0, x) for f, s, x in data], "fragment long, seq int, x double, y double, z double, t double")
    got = {}
    for r in lines.connect_fragments(df).orderBy("trace", "seq").collect():
        got.setdefault(r.trace, []).append(r.x)
    assert got == {0: [0, 1, 2, 3], 1: [5, 6], 4: [3]}


def test_streaks_and_timelines(spark):
    field = FlowField.from_numpy(spark, np.ones((3, 3, 12, 3)) * [1.0, 0.0, 0.0])
    seeds = seeds_of(spark, [(1, 1, 1)])
    streak = fronts.current(fronts.streaklines(field, seeds, 1.0, t_range=(0, 4)))
    assert sorted(x for (x,) in rows(streak, "x")) == [2, 3, 4, 5]
    line = fronts.current(fronts.timelines(field, seeds, 1.0, delay=2, t_range=(0, 4)))
    assert sorted(x for (x,) in rows(line, "x")) == [3, 5]
    aged = fronts.current(fronts.streaklines(field, seeds, 1.0, life=2, t_range=(0, 4)))
    assert sorted(x for (x,) in rows(aged, "x")) == [2, 3]


def test_critical_points_are_classified(spark):
    i, j, k = lattice(6, 6)
    for signs, kind in (((1, 1, 1), "repelling_node"), ((-1, -1, -1), "attracting_node"), ((1, -1, -1), "attracting_saddle_node"), ((1, 1, -1), "repelling_saddle_node")):
        field = FlowField.from_numpy(spark, np.stack([s * (a - 2.3) for s, a in zip(signs, (i, j, k))], -1))
        got = derive.classify_critical_points(isosurface.critical_points(field)).collect()
        assert len(got) == 1 and got[0].kind == kind and (got[0].x, got[0].y, got[0].z) == pytest.approx((2.3,) * 3)


def test_iso_surface_of_a_sphere(spark):
    i, j, k = lattice(12, 12)
    r = np.sqrt((i - 5.5) ** 2 + (j - 5.5) ** 2 + (k - 5.5) ** 2)
    got = isosurface.iso_surface(FlowField.from_numpy(spark, np.stack([r, r, r], -1)), "u", [4.0]).collect()
    tri = np.array([[[t[f"{p}{n}"] for p in "xyz"] for n in range(3)] for t in got])
    area = np.linalg.norm(np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]), axis=1).sum() / 2
    assert area == pytest.approx(4 * math.pi * 16, rel=0.05)
    normal = np.array([[t.nx, t.ny, t.nz] for t in got])
    assert ((tri.mean(1) - 5.5) * normal).sum(1).min() > 0
    edges = {}
    for t in np.round(tri, 9):
        for a, b in ((0, 1), (1, 2), (2, 0)):
            e = tuple(sorted((tuple(t[a]), tuple(t[b]))))
            edges[e] = edges.get(e, 0) + 1
    assert set(edges.values()) == {2}  # closed


def test_blocks_hold_a_bounded_number_of_points(spark, monkeypatch):
    field = rotation(spark)
    seeds = seeds_of(spark, [(9 + n / 8, 8, 2) for n in range(1, 50)])
    whole = rounds.trace_by_blocks(field, seeds, 4, RK4.fixed(0.25), 60, with_status=True)
    names = ("seed_id", "round", "block", "seq", "x", "y", "z", "t", "status")
    expected = sorted(rows(whole, *names))
    trace = rounds.trace

    def five_at_most(grid, p, *rest):
        assert len(p) <= 5
        return trace(grid, p, *rest)

    monkeypatch.setattr(rounds, "trace", five_at_most)  # goes to the workers with the function that calls it
    monkeypatch.setattr(rounds, "POINTS_AT_ONCE", 6 * 60)
    with pytest.raises(Exception, match="AssertionError"):
        rounds.trace_by_blocks(field, seeds, 4, RK4.fixed(0.25), 60)
    monkeypatch.setattr(rounds, "POINTS_AT_ONCE", 5 * 60)
    monkeypatch.setattr(rounds, "OUT_ROWS", 7)
    few = rounds.trace_by_blocks(field, seeds, 4, RK4.fixed(0.25), 60, with_status=True)
    assert sorted(rows(few, *names)) == expected and len(expected) > 1000


def test_points_meet_only_cells_whose_boxes_hold_them(spark):
    from streamweft.queries import cube_mesh

    vertices, tets = cube_mesh(spark)
    inner = [(0.3 + n % 3, 0.6 + n // 3 % 3, 0.2 + n // 9) for n in range(27)]
    edge = [(3 + 0.9e-9, 1.4, 1.3), (1.0, 1.0, 1.0), (-0.5e-9, 0.0, 0.0)]
    places = spark.createDataFrame([*inner, *edge, inner[0], (9.0, 1.0, 1.0)], "x double, y double, z double")
    assert mesh._places(places).count() == 31
    pairs = mesh._candidates(mesh._places(places), mesh.with_corners(tets, vertices), 4, 1e-9)
    assert {r["count"] for r in pairs.where("x < 3 AND x > 0 AND x <> 1").groupBy("x", "y", "z").count().collect()} == {6}
    got = mesh.locate_tets(places.withColumn("point_id", F.monotonically_increasing_id()), tets, vertices)
    assert got.count() == 32 and rows(got.where("tid IS NULL"), "x") == [(9.0,)]


def test_merged_lines_are_traced_once_and_joined_in_their_task(spark):
    field = rotation(spark, 9, 5)
    seeds = seeds_of(spark, [(6, 4, 2), (4, 4, 2), (7.5, 4, 1), (20, 4, 2), (1, 1, 1)])  # the second at rest, the fourth outside
    options = Integration(max_step=0.5)
    both = tracing.streamlines(field, seeds, Direction.BOTH, options, 40, emit_empty=True)
    merged = tracing.merge_directions(both)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    names = ("seed_id", "seq", "x", "y", "z", "t", "status")
    in_task = tracing.merged_streamlines(field, seeds, options, 40)
    assert "Window" not in in_task._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(rows(in_task, *names)) == sorted(rows(merged, *names))
    back = {(r.seed_id, -r.seq): r for r in both.where("dir = -1 AND seq IS NOT NULL").collect()}
    on = {(r.seed_id, r.seq): r for r in both.where("dir = 1 AND seq > 0").collect()}
    line = {key: (r.x, r.y, r.z, r.t, r.status) for key, r in (back | on).items()}
    expected = []
    for seed in (0, 2, 4):
        keys = sorted(k for k in line if k[0] == seed)
        expected += [(seed, n, *line[k]) for n, k in enumerate(keys)]
    assert len(expected) > 60 and sorted(rows(merged, *names)) == expected
    # a line with a forward part only keeps its seed
    assert rows(tracing.merge_directions(both.where("dir = 1")).where("seed_id = 0").orderBy("seq").limit(2), "seq", "x") == [(0, 6.0), (1, on[0, 1].x)]


def test_seeds_of_one_split_are_traced_by_all_cores(spark):
    field = rotation(spark, 9, 5)
    seeds = seeds_of(spark, [(4 + n / 50, 4, 2) for n in range(1, 150)]).coalesce(1)
    got = tracing.streamlines(field, seeds, Direction.FORWARD, RK4.fixed(0.25), 5)
    used = got.select("seed_id", F.spark_partition_id().alias("task")).distinct()
    assert used.count() == 149 and used.select("task").distinct().count() >= 2 * spark.sparkContext.defaultParallelism


def test_lookups_of_flat_nodes_are_the_trilinear_blend():
    random = np.random.default_rng(5)
    for shape in ((1, 4, 5, 6, 3), (3, 1, 5, 2, 3), (2, 3, 1, 1, 3)):
        values = random.normal(size=shape)
        top = np.array(shape[3:0:-1]) - 1.0
        grid = kernel.Grid(values, np.zeros(3), top, np.zeros(3), top)
        p = np.concatenate([random.uniform(size=(50, 3)) * top, [top, 0 * top]])
        t = random.uniform(0, shape[0] - 1, len(p))
        got, ok = grid.sample(p, t, np.arange(len(p)))
        assert ok.all()
        for q, s, v in zip(p, t, got, strict=True):
            want = np.zeros(3)
            for corner in np.ndindex(2, 2, 2, 2):
                low = np.minimum(np.floor([s, *q[::-1]]), np.maximum(np.array(shape[:4]) - 2, 0)).astype(int)
                part = np.array([s, *q[::-1]]) - low
                weight = np.prod(np.where(corner, part, 1 - part))
                want += weight * values[tuple(np.minimum(low + corner, np.array(shape[:4]) - 1))]
            np.testing.assert_allclose(v, want, atol=1e-12)


@pytest.mark.parametrize("options", [RK4.fixed(0.25), RK4, Integration()])
def test_uncertain_lines_do_not_depend_on_what_is_traced_along(options):
    random = np.random.default_rng(2)
    values = random.normal(size=(1, 5, 9, 9, 3))
    top = np.array([8.0, 8.0, 4.0])
    grid = kernel.Grid(values, np.zeros(3), top, np.zeros(3), top, spread=np.abs(values) / 5, run_seed=3)
    p, keys = random.uniform(size=(60, 3)) * top, np.arange(60)

    def lines(use, sign):
        row, seq, place, *_ = kernel.trace(grid, p[use], np.zeros(len(use)), np.full(len(use), sign), keys[use], options, 30)
        return {(int(use[r]), int(n)): tuple(q) for r, n, q in zip(row, seq, place, strict=True)}

    both = {sign: lines(np.arange(60), sign) for sign in (-1.0, 1.0)}
    for sign in (1.0, -1.0):
        apart = {}
        for n in range(0, 60, 7):
            apart |= lines(np.arange(n, min(n + 7, 60)), sign)
        assert apart == both[sign] and len(apart) > 200


def test_uncertain_field_without_spread_is_deterministic(spark):
    field = rotation(spark)
    sure = field.with_nodes(field.nodes.withColumns({f"s{c}": F.lit(0.0) for c in "uvw"}))
    seeds = seeds_of(spark, [(12, 8, 2)])
    a = tracing.streamlines(field, seeds, Direction.FORWARD, RK4.fixed(0.25), 20)
    b = tracing.uncertain_streamlines(sure, seeds, 3, direction=Direction.FORWARD, options=RK4.fixed(0.25), max_points=20)
    assert sorted(rows(a, "seq", "x", "y")) * 1 == sorted(set(rows(b, "seq", "x", "y"))) and b.count() == 60


def test_compatible_seeds_match_the_c_generator(spark):
    draw = seeding.additive_feedback()
    assert [next(draw) for _ in range(5)] == [1804289383, 846930886, 1681692777, 1714636915, 1957747793]
    got = seeding.compatible_seeds(spark, (0, 0, 0), (47, 47, 47), 2).orderBy("seed_id").collect()
    assert (got[0].x, got[0].y, got[0].z) == pytest.approx((39.488823, 18.535997, 36.805664), abs=1e-5)


def test_seeding_rules(spark):
    assert [seeding.rake_dimension((0, 0, 0), h) for h in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1))] == [0, 1, 2, 3]
    assert rows(seeding.regular_seeds(spark, (0, 0, 0), (4, 0, 0), [3]).orderBy("seed_id"), "x") == [(1,), (2,), (3,)]
    plane = rows(seeding.regular_seeds(spark, (0, 1, 0), (2, 1, 4), [2, 3]).orderBy("seed_id"), "x", "y", "z")
    assert plane == [(0, 1, 0), (2, 1, 0), (0, 1, 2), (2, 1, 2), (0, 1, 4), (2, 1, 4)]
    assert seeding.regular_seeds(spark, (1, 1, 1), (1, 1, 1), [5, 5, 5]).count() == 1
    a = seeding.random_seeds(spark, (0, 0, 0), (1, 1, 0), 50, 3)
    assert sorted(rows(a, "x", "y", "z")) == sorted(rows(a.repartition(7), "x", "y", "z"))
    assert seeding.resample(a, 20).count() == 20


def test_decomposition(spark):
    assert blocks.factor_blocks((12, 12, 7), 12) == (2, 2, 3) and blocks.factor_blocks((8, 8, 8, 10), 8, (0, 0, 0, 2)) == (2, 2, 1, 2)
    assert blocks.bisect((0, 0, 0), (3, 3, 3), 2)[0] == ((0, 0, 0), (1, 1, 3))
    b = blocks.block_bounds(spark, (10, 10, 10), (3, 1, 1))
    assert rows(b.orderBy("gid"), "real_lo_x", "real_hi_x") == [(0, 3), (3, 6), (6, 9)]
    assert rows(blocks.assign_contiguous(b, 3, 2).orderBy("gid"), "proc") == [(0,), (0,), (1,)]
    n = blocks.lattice_neighbours(b, (3, 1, 1), faces_only=True)
    assert sorted(rows(n, "gid", "neighbour")) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert blocks.lattice_neighbours(b, (3, 1, 1), True, (True,)).where("gid = 0 AND neighbour = 2").count() == 1


def test_mesh_location(spark):
    from streamweft.queries import cube_mesh

    vertices, tets = cube_mesh(spark, 3)
    p = spark.createDataFrame([(1, 0.5, 1.25, 1.9), (2, 1.0, 1.0, 1.0), (3, 5.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    values = vertices.select("vid", F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"))
    got = {r.point_id: (r.u, r.v, r.w) for r in mesh.sample_tets(p, tets, vertices, values).collect()}
    assert got[1] == pytest.approx((0.5, 1.25, 1.9)) and got[2] == pytest.approx((1, 1, 1)) and got[3] == (None,) * 3
    assert mesh.face_adjacency(tets).where("neighbour IS NULL").count() == 6 * 4 * 2


def test_cells_of_very_different_sizes_are_found(spark):
    """One tetrahedron a thousand times as large as the others."""
    corner = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    data = [(4 * n + q, n * 2 + s * p[0], s * p[1], s * p[2]) for n, s in ((0, 1.0), (1, 1.0), (50, 1000.0)) for q, p in enumerate(corner)]
    ids = {n: k for k, n in enumerate((0, 1, 50))}
    vertices = spark.createDataFrame([(4 * ids[(v // 4)] + v % 4, float(x), float(y), float(z)) for v, x, y, z in data], "vid long, x double, y double, z double")
    tets = spark.createDataFrame([(k, *(4 * k + q for q in range(4))) for k in range(3)], "tid long, v0 long, v1 long, v2 long, v3 long")
    p = spark.createDataFrame([(1, 0.2, 0.2, 0.2), (2, 2.1, 0.1, 0.1), (3, 400.0, 200.0, 100.0), (4, -5.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    got = {r.point_id: r.tid for r in mesh.locate_tets(p, tets, vertices).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: None}


def test_aggregates(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "proc int, steps double")
    r = aggregate.run_statistics(df, "proc", "steps", integer_means=True).first()
    assert (r.total, r.argmin, r.argmax, r.mean) == (5, 0, 1, 1) and r.variance == pytest.approx(2 / 3)
    points, nodes = aggregate.kd_tree(seeding.random_seeds(spark, (0, 0, 0), (1, 1, 1), 400), 3)
    counts = [n for (n,) in rows(points.groupBy("leaf").count(), "count")]
    assert len(counts) == 8 and max(counts) < 80
    q = points.first()
    assert aggregate.kd_search(nodes, 3, q.x, q.y, q.z) == q.leaf
    merged = aggregate.merge_blocks(spark.range(20).select(F.col("id").alias("gid"), F.col("id").alias("n")), "gid", lambda p: p[["n"]].sum().to_frame().T, "gid long, n long", 4)
    assert rows(merged, "n") == [(190,)]


def test_transforms(spark):
    field = rotation(spark, 5, 3)
    once = transform.normalize_local(field)
    assert transform.normalize_global(once) is once
    assert all(math.hypot(u, v) == pytest.approx(1) or u == v == 0 for u, v in rows(once.nodes, "u", "v"))
    scanned = transform.scan_field(field, lambda p: p.assign(w=p.u + 1))
    assert rows(scanned.nodes.where("w <> u + 1"), "w") == []
    assert transform.slice_at(field, Axis.X, 2).count() == 15
    tang = lines.tangents(tracing.streamlines(field, seeds_of(spark, [(3, 2, 1)]), Direction.FORWARD, RK4.fixed(0.2), 10))
    assert all(math.hypot(a, b) == pytest.approx(1) for a, b in rows(tang, "tx", "ty"))
    assert lines.tubes(tang.drop("tx", "ty", "tz"), 0.1, 4).count() == 40


def test_binary_fields_round_trip(spark, tmp_path):
    values = np.random.default_rng(1).random((4, 5, 6, 3)).astype(np.float32)
    field = FlowField.from_numpy(spark, values)
    path = str(tmp_path / "a.vec")
    binary.write_vec(field, path)
    again = binary.read_vec(spark, path)
    assert again.dims == (6, 5, 4) and np.array_equal(again.to_numpy()[0], values.astype(float))
    part = binary.read_vec(spark, path, lo=(1, 2, 1), hi=(3, 4, 2))
    assert np.array_equal(part.to_numpy()[0], values[1:3, 2:5, 1:4].astype(float))
    assert again.nodes.where("k = 2 AND j >= 3").count() == 12
    raw = str(tmp_path / "a.raw")
    assert binary.vec_to_raw(path, raw) == (6, 5, 4)
    binary.raw_to_vec(raw, str(tmp_path / "b.vec"), (6, 5, 4))
    assert (tmp_path / "b.vec").read_bytes() == (tmp_path / "a.vec").read_bytes()
    (tmp_path / "list").write_text("2 # steps\na.vec\nb.vec\n")
    series = binary.read_series(spark, lists.read_list(str(tmp_path / "list")))
    assert series.t_range == (0, 1) and series.nodes.where("t = 1").count() == 120
    (tmp_path / "plist").write_text("6 5 4 1 # dims\n2.0 # scale\na.raw\n")
    scaled = binary.read_series(spark, lists.read_parallel_list(str(tmp_path / "plist")))
    assert np.allclose(scaled.to_numpy()[0], values.astype(float) * 2)
    assert binary.swap_bytes(struct.pack(">i", 7), 4) == struct.pack("<i", 7)


def test_other_formats(spark, tmp_path):
    dims, n = (3, 2, 2), 12
    planes = np.arange(5 * n, dtype="<f4").reshape(5, n)
    (tmp_path / "s.soln").write_bytes(np.array(dims, "<i4").tobytes() + np.zeros(4, "<f4").tobytes() + planes.tobytes())
    got = formats.read_plot3d_solution(spark, str(tmp_path / "s.soln")).to_numpy()[0].reshape(-1, 3)
    want = np.where(planes[0][:, None] == 0, 0, planes[1:4].T / np.maximum(planes[0][:, None], 1e-9))
    assert np.allclose(got, want)
    (tmp_path / "seeds").write_text("2\n1 2 3\n4 5 6\n")
    assert rows(lists.read_seed_file(spark, str(tmp_path / "seeds")).orderBy("seed_id"), "x", "z") == [(1, 3), (4, 6)]
    points = spark.createDataFrame([(s, 1, q, float(s), float(q), 0.0, 0.5) for s in (3, 8) for q in range(s)], "seed_id long, dir int, seq int, x double, y double, z double, t double")
    path = str(tmp_path / "lines")
    assert formats.write_trajectories(points, path, (0,) * 4, (9,) * 4, path + ".ids") == 2
    back = formats.read_trajectories(spark, path)
    assert sorted(rows(back, "x", "seq", "y")) == sorted((float(s), q, float(q)) for s in (3, 8) for q in range(s))
    formats.write_partition(str(tmp_path / "part"), (4, 4, 4, 1), 2, 1, (2, 4, 4, 1), [(0, 0, *[0] * 4, 2, 3, 3, 0), (1, 1, 2, 0, 0, 0, 3, 3, 3, 0)])
    assert rows(formats.read_partition(spark, str(tmp_path / "part")).orderBy("gid"), "proc", "lo_x", "hi_x") == [(0, 0, 2), (1, 2, 3)]
    field = rotation(spark, 4, 3)
    formats.write_vtk(field, str(tmp_path / "f.vtk"))
    assert np.allclose(formats.read_vtk(spark, str(tmp_path / "f.vtk")).to_numpy(), field.to_numpy())
    formats.write_volume(field.nodes, field.dims, "u", str(tmp_path / "u"))
    assert os.path.getsize(tmp_path / "u.raw") == 4 * 48


def test_netcdf_classic(tmp_path):
    def name(s):
        return struct.pack(">i", len(s)) + s.encode().ljust((len(s) + 3) // 4 * 4, b"\0")

    dims = [("z", 2), ("y", 3), ("x", 4)]
    u = np.arange(24, dtype=">f4").reshape(2, 3, 4)
    u[0, 0, 0] = -999
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 3) + b"".join(name(d) + struct.pack(">i", n) for d, n in dims) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1)
    var = name("u") + struct.pack(">i", 3) + struct.pack(">iii", 0, 1, 2) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 5, 96)
    begin = len(head) + len(var) + 4
    (tmp_path / "f.nc").write_bytes(head + var + struct.pack(">i", begin) + u.tobytes())
    got = formats.read_netcdf(str(tmp_path / "f.nc"), ["u", None, "NULL"], [-999.0, None, None])
    assert got.shape == (2, 3, 4, 3) and got[0, 0, 0, 0] == 0 and got[1, 2, 3, 0] == 23 and not got[..., 1:].any()


def test_live_particles_as_a_stream(spark, tmp_path):
    from streamweft.streaming import live_particles

    field = FlowField.from_numpy(spark, np.ones((3, 3, 6, 3)) * [1.0, 0.0, 0.0])
    events = seeds_of(spark, [(1, 1, 1)])
    for n in range(3):
        events.coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live_particles(field, stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("live"), "age", "x")) == [(0, 1.0), (1, 2.0), (2, 3.0)]
