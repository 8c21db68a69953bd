"""Streamlines, pathlines and their relatives.

A field whose dense size is at most ``BROADCAST_BYTES`` (known from its grid)
goes to every executor once and seeds are traced in batches.  Stream- and
pathlines of a larger one are traced by blocks (``rounds``): the field stays
partitioned and particles travel; an uncertain field has to fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..field import FlowField
from ..schema import TRACE_ROWS, Direction, Integration, Order
from .kernel import STATUS, Grid, clip_share, step, trace

BROADCAST_BYTES = 256 << 20
#: Values of a block of a larger field, without ghosts.
BLOCK_BYTES = 32 << 20
#: Points that a task holds of one direction, at most: seeds are traced as many at a time as may reach them.
POINTS_AT_ONCE = 1 << 20
#: Rows of a batch sent back to Spark.
OUT_ROWS = 1 << 16


def dense_grid(field: FlowField, run_seed: int = 0, normalize: bool = False) -> Grid:
    """The field as arrays on the driver; refused above ``BROADCAST_BYTES``."""
    if field.size_bytes() > BROADCAST_BYTES:
        raise ValueError("the field is too large to broadcast; trace it by blocks")
    spread = None
    if {"su", "sv", "sw"} <= set(field.nodes.columns):
        spread = field.with_nodes(field.nodes.select("t", "i", "j", "k", *(F.col(f"s{c}").alias(c) for c in "uvw"))).to_numpy()
    return Grid(field.to_numpy(), field.lo, field.hi, field.real_lo, field.real_hi, float(field.t_range[0]), spread, run_seed, normalize)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, three tasks a core.  A few bytes of a seed make many points, so neither the
    splits of its file nor AQE's sizes say how much work it is; a number given here is kept by AQE."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns)


def _lines(found: tuple, n: int) -> tuple:
    """The points of ``trace`` line by line (row, seq, place, when), and each line's count and status."""
    row, seq, place, when, state = found
    counts = np.bincount(row, minlength=n)
    order = np.empty(len(row), np.int64)
    order[(np.cumsum(counts) - counts)[row] + seq] = np.arange(len(row))  # seq has no gaps
    return row[order], seq[order], place[order], when[order], counts, state


def _merged(back: tuple, on: tuple) -> tuple:
    """One line a seed: the backward one reversed, then the forward one, the shared seed once."""
    first, second = back[4], on[4]
    row_b, seq_b, place_b, when_b = back[:4]
    row_f, seq_f, place_f, when_f = (c[(on[1] > 0) | (first[on[0]] == 0)] for c in on[:4])
    joint = (first > 0) & (second > 0)
    counts = first + second - joint
    start = np.cumsum(counts) - counts
    n, cut = int(counts.sum()), len(row_b)
    order = np.empty(n, np.int64)
    order[start[row_b] + first[row_b] - 1 - seq_b] = np.arange(cut)
    order[start[row_f] + first[row_f] + seq_f - joint[row_f]] = np.arange(cut, n)
    row, place, when = (np.concatenate(c)[order] for c in ((row_b, row_f), (place_b, place_f), (when_b, when_f)))
    return row, np.arange(n) - start[row], place, when, np.concatenate([back[5][row_b], on[5][row_f]])[order]


def _batches(seed: np.ndarray, sign: int | None, row: np.ndarray, seq: np.ndarray, place: np.ndarray, when: np.ndarray, state: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Record batches of points, ``state`` one a point; without ``sign`` no dir."""
    names, status = pa.array(STATUS), state.astype(np.int8)
    for low in range(0, len(row), OUT_ROWS):
        part = slice(low, low + OUT_ROWS)
        lead = [] if sign is None else [pa.array(np.full(len(row[part]), sign, np.int32))]
        columns = [pa.array(seed[row[part]]), *lead, pa.array(seq[part].astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in place[part].T), pa.array(when[part]), names.take(pa.array(status[part]))]
        yield pa.RecordBatch.from_arrays(columns, names=["seed_id", *["dir"] * len(lead), "seq", "x", "y", "z", "t", "status"])


def _signs(direction: Direction) -> list[float]:
    return [s for bit, s in ((Direction.BACKWARD, -1.0), (Direction.FORWARD, 1.0)) if direction & bit]


def _trace(field: FlowField, seeds: DataFrame, direction: Direction, options: Integration, max_points: int, run_seed: int, least: int, steady: bool, empty: bool, normalize: bool, merge: bool = False) -> DataFrame:
    grid = seeds.sparkSession.sparkContext.broadcast(dense_grid(field, run_seed, normalize))
    t0 = float(field.t_range[0])
    rows = seeds.select("seed_id", "x", "y", "z", (F.col("t").cast("double") if "t" in seeds.columns else F.lit(t0)).alias("t"))
    at_once = max(1, POINTS_AT_ONCE // max(max_points, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grid.value
        if steady and g.time_varying:
            g = replace(g, values=g.values[:1], real_t=None)
        for batch in (b.slice(low, at_once) for b in batches for low in range(0, b.num_rows, at_once)):
            ids = batch.column("seed_id").to_numpy()
            p = np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
            t = batch.column("t").to_numpy()
            lines = {int(s): _lines(trace(g, p, t, np.full(len(ids), s), ids, options, max_points), len(ids)) for s in _signs(direction)}
            if merge:
                yield from _batches(ids, None, *_merged(lines[-1], lines[1]))
                continue
            for sign, (row, seq, place, when, counts, state) in lines.items():
                if empty and (counts == 0).any():
                    gone = np.flatnonzero(counts == 0)
                    none = [pa.array(ids[gone]), pa.array(np.full(len(gone), sign, np.int32)), *(pa.nulls(len(gone), k) for k in (pa.int32(), *[pa.float64()] * 4)), pa.array(STATUS).take(pa.array(state[gone]))]
                    yield pa.RecordBatch.from_arrays(none, names=["seed_id", "dir", "seq", "x", "y", "z", "t", "status"])
                use = slice(None) if least <= 1 else (counts >= least)[row]
                yield from _batches(ids, sign, row[use], seq[use], place[use], when[use], state[row[use]])

    return spread(rows).mapInArrow(run, TRACE_ROWS.replace("dir int, ", "") if merge else TRACE_ROWS)


def _by_blocks(field: FlowField, seeds: DataFrame, direction: Direction, options: Integration, max_points: int, least: int, empty: bool, normalize: bool) -> DataFrame:
    """The rows of ``_trace`` by blocks.  Ghost layers reach as far as the longest step does at the
    field's largest speed (one aggregation)."""
    from .rounds import trace_by_blocks

    if {"su", "sv", "sw"} <= set(field.nodes.columns):
        raise ValueError("an uncertain field is too large to broadcast")
    longest = options.max_step if options.adaptive else options.step
    fastest = 1.0 if normalize else float(field.nodes.agg(F.max(F.greatest(F.abs("u"), F.abs("v"), F.abs("w")))).first()[0] or 0.0)
    ghost = int(np.ceil(2 * longest * fastest / min(field.spacing))) + 1
    n_blocks = max(1, int(np.ceil(field.size_bytes() / BLOCK_BYTES)))
    out = None
    for s in _signs(direction):
        got = trace_by_blocks(field, seeds, n_blocks, options, max_points, ghost, direction=int(s), normalize=normalize, with_status=True)
        last = got.groupBy("seed_id").agg(F.max_by("status", F.struct("round", "seq")).alias("status"), F.count("*").alias("n"))
        w = Window.partitionBy("seed_id").orderBy("round", "seq")
        lines = got.drop("status").withColumn("seq", (F.row_number().over(w) - 1).cast("int")).join(last.where(F.col("n") >= least), "seed_id")
        lines = lines.select("seed_id", F.lit(int(s)).alias("dir"), "seq", "x", "y", "z", "t", "status")
        if empty:
            gone = seeds.join(last.select("seed_id"), "seed_id", "left_anti")
            inside = F.lit(True)
            for p, a, b in zip("xyz", field.lo, field.hi, strict=True):
                inside = inside & F.col(p).between(float(a), float(b))
            null = [F.lit(None).cast("int").alias("seq"), *(F.lit(None).cast("double").alias(c) for c in "xyzt")]
            lines = lines.unionByName(gone.select("seed_id", F.lit(int(s)).alias("dir"), *null, F.when(inside, F.lit("CRITICAL")).otherwise(F.lit("OUT_OF_BOUND")).alias("status")))
        out = lines if out is None else out.unionByName(lines)
    return out


def streamlines(field: FlowField, seeds: DataFrame, direction: Direction = Direction.BOTH, options: Integration = Integration(), max_points: int = 1000, emit_empty: bool = False, run_seed: int = 0, normalize: bool = False) -> DataFrame:
    """Trace points (seed_id, dir, seq, x, y, z, t, status) of steady lines, dir -1 and 1.

    Seed ids are unique where the field is traced by blocks.  A seed outside or at rest has no points; with ``emit_empty`` it has one row
    with null seq and its status.  An uncertain field draws at each lookup.
    """
    if field.size_bytes() > BROADCAST_BYTES:
        t0 = field.t_range[0]
        steady = field.with_nodes(field.nodes.where(F.col("t") == t0), t_range=(t0, t0)) if field.time_varying else field
        return _by_blocks(steady, seeds, direction, options, max_points, 1, emit_empty, normalize)
    return _trace(field, seeds, direction, options, max_points, run_seed, 1, True, emit_empty, normalize)


def pathlines(field: FlowField, seeds: DataFrame, direction: Direction = Direction.FORWARD, options: Integration = Integration(), max_points: int = 1000) -> DataFrame:
    """Trace points of unsteady lines from seeds with their own t (or the field's first step);
    lines of one point are left out."""
    if field.size_bytes() > BROADCAST_BYTES:
        return _by_blocks(field, seeds, direction, options, max_points, 2, False, False)
    return _trace(field, seeds, direction, options, max_points, 0, 2, False, False, False)


def advect_once(field: FlowField, points: DataFrame, h: float, order: Order = Order.RK45, direction: int = 1) -> DataFrame:
    """``points`` (seed_id, x, y, z, t) one step on, with status FAIL and the old place where a stage was outside."""
    grid = points.sparkSession.sparkContext.broadcast(dense_grid(field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, p = batch.column("seed_id").to_numpy(), np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
            t = batch.column("t").to_numpy()
            new, ok, _ = step(grid.value.sample, order, p, t, np.full(len(p), float(h)), np.full(len(p), float(direction)), ids)
            new, t = np.where(ok[:, None], new, p), np.where(ok, t + h * direction, t)
            yield pa.RecordBatch.from_arrays([batch.column("seed_id"), *(pa.array(np.ascontiguousarray(c)) for c in new.T), pa.array(t), pa.array(np.where(ok, "OKAY", "FAIL").astype(object), pa.string())], names=["seed_id", "x", "y", "z", "t", "status"])

    return points.select("seed_id", "x", "y", "z", F.col("t").cast("double").alias("t")).mapInArrow(run, "seed_id long, x double, y double, z double, t double, status string")


def advect_interval(field: FlowField, points: DataFrame, start: float, end: float, order: Order = Order.FOURTH, grid: Broadcast | None = None) -> DataFrame:
    """Particles from time ``start`` to ``end`` (either way) in two equal steps.  ``grid`` is the
    field's broadcast, if the caller has it already."""
    h, sign = abs(end - start) / 2, 1 if end >= start else -1
    grid = grid or points.sparkSession.sparkContext.broadcast(dense_grid(field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, p = batch.column("seed_id").to_numpy(), np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
            t, alive = np.full(len(p), float(start)), np.ones(len(p), bool)
            for _ in range(2):
                new, ok, _ = step(grid.value.sample, order, p, t, np.full(len(p), h), np.full(len(p), float(sign)), ids)
                alive &= ok
                p, t = np.where(alive[:, None], new, p), np.where(alive, t + h * sign, t)
            yield pa.RecordBatch.from_arrays([batch.column("seed_id"), *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(t), pa.array(np.where(alive, "OKAY", "OUT_OF_BOUND").astype(object), pa.string())], names=["seed_id", "x", "y", "z", "t", "status"])

    return points.select("seed_id", "x", "y", "z").mapInArrow(run, "seed_id long, x double, y double, z double, t double, status string")


def _meets_itself(row: np.ndarray, place: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether an earlier point of the same line lies in the same cell of width ``tolerance`` or in
    one beside it.  Points are sorted by line and number; cells are compared by 64-bit hashes."""
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    cell = np.floor(place / tolerance).astype(np.int64)
    code = lambda c: (c.astype(np.uint64) * mix).sum(1, dtype=np.uint64) ^ (row.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))
    own = code(cell)
    first, at = np.unique(own, return_index=True)  # the earliest point of each cell
    out = np.zeros(len(row), bool)
    for n in range(27):
        asked = code(cell + np.array([n % 3 - 1, n // 3 % 3 - 1, n // 9 - 1]))
        k = np.minimum(np.searchsorted(first, asked), max(len(first) - 1, 0))
        if len(first):
            out |= (first[k] == asked) & (at[k] < np.arange(len(row)))
    return out


def infinite_lines(field: FlowField, seeds: DataFrame, options: Integration = Integration(), direction: int = 1, length: float = 4000.0, tolerance: float = 1e-6, max_points: int = 10_000) -> DataFrame:
    """Steady lines until they leave the domain (the last point lies on the boundary), meet one
    of their own points, come to rest, or have taken steps of ``length`` in all."""
    grid = seeds.sparkSession.sparkContext.broadcast(dense_grid(field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, ids = grid.value, batch.column("seed_id").to_numpy()
            p = np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
            row, seq, place, when, state = trace(g, p, np.full(len(p), g.t0), np.full(len(p), float(direction)), ids, options, max_points)
            order = np.lexsort((seq, row))
            row, seq, place, when = row[order], seq[order], place[order], when[order]
            n = len(row)
            head = np.append(True, row[1:] != row[:-1])[:n]
            steps = np.abs(np.diff(when, prepend=when[:1]))
            steps[head] = 0.0
            run_ = np.cumsum(steps)
            far = run_ - np.repeat(run_[head], np.diff(np.append(np.flatnonzero(head), n))) > length
            near = _meets_itself(row, place, tolerance)
            ends = np.full(len(ids), 1 << 62)
            stop = near | far
            np.minimum.at(ends, row[stop], seq[stop])
            use = seq <= ends[row]
            status = np.array(STATUS, object)[state]
            last = np.flatnonzero(stop & (seq == ends[row]))
            status[row[last]] = np.where(near[last], "LOOP", "MAX_LENGTH")
            row, seq, place = row[use], seq[use], place[use]
            tail = np.flatnonzero(np.append(row[1:] != row[:-1], True)[: len(row)])
            out = tail[(status[row[tail]] == "OUT_OF_BOUND") & (seq[tail] > 0)]
            place[out] = place[out - 1] + clip_share(place[out - 1], place[out], g.real_lo, g.real_hi)[:, None] * (place[out] - place[out - 1])
            on = tail[(status[row[tail]] == "OKAY") | ((status[row[tail]] == "OUT_OF_BOUND") & (seq[tail] == 0))]
            v, ok = g.sample(place[on], np.full(len(on), g.t0), ids[row[on]])
            moves = ok & (np.abs(v).max(1) > 0) if len(on) else np.zeros(0, bool)
            status[row[on]] = "OUT_OF_BOUND"
            on, v = on[moves], v[moves]
            end = place[on] + direction * v / np.linalg.norm(v, axis=1, keepdims=True) * np.linalg.norm(g.hi - g.lo)
            extra = place[on] + clip_share(place[on], end, g.real_lo, g.real_hi)[:, None] * (end - place[on])
            far = np.abs(extra - place[on]).max(1, initial=0.0) > 1e-9  # else the last point lies on the boundary already
            on, extra = on[far], extra[far]
            row, seq, place = np.append(row, row[on]), np.append(seq, seq[on] + 1), np.concatenate([place, extra])
            columns = [ids[row], np.full(len(row), direction), seq, *place.T, seq.astype(float)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, kinds, strict=True)), pa.array(status[row], pa.string())], names=["seed_id", "dir", "seq", "x", "y", "z", "t", "status"])

    return seeds.select("seed_id", "x", "y", "z").mapInArrow(run, TRACE_ROWS)


def merge_directions(points: DataFrame) -> DataFrame:
    """One line a seed: the backward part reversed, the shared seed once, then the forward part.
    ``points`` are read and sorted once."""
    seed = F.col("seq") == 0
    w = Window.partitionBy("seed_id").orderBy("place", "dir").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = points.where("seq IS NOT NULL").withColumn("place", F.when(F.col("dir") < 0, -F.col("seq")).otherwise(F.col("seq")))
    # the seed's backward copy sorts before its forward one
    rows = rows.withColumns({"shared": F.max(seed & (F.col("dir") == -1)).over(w), "ahead": F.count(F.when(seed & (F.col("dir") == 1), 1)).over(w), "number": F.count("*").over(w)})
    number = F.col("number") - 1 - F.when(F.col("shared"), F.col("ahead")).otherwise(0)
    return rows.where(~(seed & (F.col("dir") == 1) & F.col("shared"))).withColumn("seq", number.cast("int")).drop("place", "dir", "shared", "ahead", "number")


def merged_streamlines(field: FlowField, seeds: DataFrame, options: Integration = Integration(), max_points: int = 1000, run_seed: int = 0, normalize: bool = False) -> DataFrame:
    """Steady lines in both directions as one line a seed (seed_id, seq, x, y, z, t, status), as
    ``merge_directions`` makes them.  Both parts of a line are traced in one task and joined there."""
    if field.size_bytes() > BROADCAST_BYTES:
        return merge_directions(streamlines(field, seeds, Direction.BOTH, options, max_points, run_seed=run_seed, normalize=normalize))
    return _trace(field, seeds, Direction.BOTH, options, max_points, run_seed, 1, True, False, normalize, merge=True)


def uncertain_streamlines(field: FlowField, seeds: DataFrame, samples: int, run_seed: int = 0, **options) -> DataFrame:
    """``samples`` streamlines of every seed through an uncertain field."""
    from ..operators.seeding import ensemble_seeds

    out = streamlines(field, ensemble_seeds(seeds, samples), run_seed=run_seed, **options)
    return out.withColumn("source_id", F.floor(F.col("seed_id") / samples).cast("long")).withColumn("sample", F.pmod("seed_id", F.lit(samples)).cast("int"))
