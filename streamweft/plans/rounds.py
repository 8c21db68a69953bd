"""Tracing by blocks: particles travel, the field stays.

Every block is one row (a brick of dense values with ghost nodes).  A round
brings active particles to the bricks, traces each inside its block until
it leaves the real box, and sends its last point to the block that holds it.
Rounds end when nobody is active.  Round tables are written to the shared
folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..field import FlowField
from ..operators.blocks import block_bounds, factor_blocks, halo_nodes, point_to_block, with_ghosts
from ..schema import Integration
from .kernel import STATUS, Grid, trace
from .tracing import OUT_ROWS, POINTS_AT_ONCE

_POINTS = "seed_id long, round int, block int, seq int, x double, y double, z double, t double"
_MOVED = _POINTS + ", status string, last boolean, h double, px double, py double, pz double"
#: Particles that one task traces in a block; the brick of a crowded block goes to several.
CROWD = 20_000


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a folder of this machine serves a local master,
    until the process ends; a cluster has to name one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="streamweft-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write into the shared folder and read back: a lost executor costs no earlier step."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bricks(field: FlowField, blocks: DataFrame) -> DataFrame:
    """(block, bounds, values): the nodes of each block's ghost box as one binary of doubles; steps count from the field's first."""
    nodes = field.nodes.select((F.col("t") - field.t_range[0]).cast("int").alias("t"), "i", "j", "k", "u", "v", "w")
    rows = halo_nodes(nodes, blocks)
    boxes = blocks.select(F.col("gid").alias("block"), *(f"{a}{s}_{p}" for a in ("", "real_") for s in ("lo", "hi") for p in "xyzt"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        at = {c: table.column(c).to_numpy() for c in "tijk"}
        low, high = {c: int(a.min()) for c, a in at.items()}, {c: int(a.max()) for c, a in at.items()}
        shape = tuple(high[c] - low[c] + 1 for c in "tkji") + (3,)
        values = np.zeros(shape)
        values[tuple(at[c] - low[c] for c in "tkji")] = np.stack([table.column(c).to_numpy() for c in "uvw"], 1)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "shape": pa.array([list(shape)], pa.list_(pa.int32())), "corner": pa.array([[low[c] for c in "ijkt"]], pa.list_(pa.int32())), "values": pa.array([values.tobytes()], pa.binary())})

    packed = rows.groupBy("block").applyInArrow(pack, "block int, shape array<int>, corner array<int>, values binary")
    return packed.join(F.broadcast(boxes), "block")


def _grid(field_lo: Sequence[float], spacing: Sequence[float], t0: int, brick: dict, domain: tuple[np.ndarray, np.ndarray], normalize: bool) -> Grid:
    shape = tuple(brick["shape"])
    corner = np.array(brick["corner"], float)
    values = np.frombuffer(brick["values"], float).reshape(shape)
    lo = np.array(field_lo) + corner[:3] * spacing
    hi = lo + (np.array(shape[3:0:-1]) - 1) * spacing
    real = [np.array(field_lo) + np.array([brick[f"real_{s}_{p}"] for p in "xyz"]) * spacing for s in ("lo", "hi")]
    return Grid(values, lo, hi, *real, t0=t0 + float(corner[3]), normalize=normalize, real_t=(t0 + float(brick["real_lo_t"]), t0 + float(brick["real_hi_t"])), domain=domain)


def trace_by_blocks(
    field: FlowField, seeds: DataFrame, n_blocks: int, options: Integration, max_points: int = 1000, ghost: int = 1, max_rounds: int | None = None,
    time_blocks: int = 1, direction: int = 1, normalize: bool = False, with_status: bool = False,
) -> DataFrame:
    """Trace points (seed_id, round, block, seq, x, y, z, t[, status]) through a decomposed field.

    A particle that leaves its block's real box goes on in the block that holds
    its last point, with its number of steps, step length and point before, so
    lines are those of the whole field; the point shared by two fragments is
    kept once.  Particles end outside the domain, at rest, or after ``max_points``;
    every round takes each at least one point further, so rounds end by
    themselves.  If some particles still travel after ``max_rounds``, or a step
    needs nodes beyond the ``ghost`` layers, it raises.

    Only bricks of blocks with particles are read; a crowded block's particles
    are split over tasks, each with the brick.  A task reads its brick first and then particles batch
    by batch, and holds ``POINTS_AT_ONCE`` points at most, however many the particles are.
    """
    spark = seeds.sparkSession
    dims = (*field.dims, field.t_range[1] - field.t_range[0] + 1)
    counts = factor_blocks(dims, n_blocks * time_blocks, (0, 0, 0, time_blocks))
    blocks = with_ghosts(block_bounds(spark, dims, counts), dims, (ghost,) * 6 + ((0, ghost) if direction > 0 else (ghost, ghost)), clamp=True)
    stored = shared_table(bricks(field, blocks), "bricks")
    lo, spacing = field.lo, field.spacing
    place = [((F.col(p) - F.lit(float(a))) / F.lit(float(s))).alias(p) for p, a, s in zip("xyz", lo, spacing, strict=True)]
    t0 = field.t_range[0]
    times = field.t_range if field.time_varying else (-np.inf, np.inf)
    domain = (np.array([*field.lo, times[0]], float), np.array([*field.hi, times[1]], float))

    def keyed(df: DataFrame) -> DataFrame:
        inner = df.select("*", F.struct(*place, (F.col("t") - t0 if field.time_varying else F.lit(0.0)).alias("t")).alias("g"))
        return inner.withColumn("block", point_to_block(dims, counts, ("g.x", "g.y", "g.z", "g.t"))).drop("g").where("block >= 0")

    first = F.col("t").cast("double") if "t" in seeds.columns else F.lit(float(t0))
    none = F.lit(None).cast("double")
    active = keyed(seeds.select("seed_id", "x", "y", "z", first.alias("t")).withColumns({"seq": F.lit(0), **{c: none for c in ("h", "px", "py", "pz")}}))
    points: DataFrame | None = None
    names = [c.split()[0] for c in _MOVED.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.bool_(), *[pa.float64()] * 4)

    at_once = max(1, POINTS_AT_ONCE // max(max_points, 1))

    def advance_in(round_: int):
        def some(grid: Grid, block: int, left: pa.RecordBatch) -> pa.RecordBatch:
            ids, seq0 = left.column("seed_id").to_numpy(), left.column("seq").to_numpy()
            p = np.stack([left.column(c).to_numpy() for c in "xyz"], 1)
            number_of = lambda c: left.column(c).to_numpy(zero_copy_only=False).astype(float)
            carry = {"h": number_of("h"), "previous": np.stack([number_of(c) for c in ("px", "py", "pz")], 1)}
            row, seq, where, when, state = trace(grid, p, left.column("t").to_numpy(), np.full(len(ids), float(direction)), ids, options, max_points, carry)
            number = seq0[row] + seq
            last = np.zeros(len(ids), np.int64)
            np.maximum.at(last, row, seq)
            ended = seq == last[row]
            use = number < max_points
            row, seq, where, when, number, ended = row[use], seq[use], where[use], when[use], number[use], ended[use]
            last = np.minimum(last, max_points - 1 - seq0)
            ends = seq == last[row]
            # goes on elsewhere: left the real box, or a stage needed nodes beyond the ghosts
            on = ends & (seq > 0) & np.isin(state[row], (1, 2)) & (number < max_points - 1)
            if grid.short:
                own = (where > grid.real_lo).all(1) & (where <= grid.real_hi).all(1)
                if (own & ends & (options.adaptive | (state[row] == 1)) & np.isin(ids[row], list(grid.short))).any():
                    raise ValueError(f"a step needs nodes beyond the {ghost} ghost layers of its block")
            new = (seq > 0) | (seq0[row] == 0)
            full = (number == max_points - 1) & ~(ended & np.isin(state[row], (2, 3)))
            status = pa.array(STATUS).take(pa.array(np.where(full, 5, state[row])[new]))
            columns = [ids[row], np.full(len(row), round_), np.full(len(row), block), number, *where.T, when, status, on, carry["h"][row], *carry["previous"][row].T]
            return pa.RecordBatch.from_arrays([c if n == "status" else pa.array(np.ascontiguousarray(c)[new], k) for n, c, k in zip(names, columns, kinds, strict=True)], names=names)

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grid, block, waiting = None, -1, []
            for batch in batches:
                found = batch.column("brick")
                if found.null_count < len(found):
                    brick = found.drop_null()[0].as_py()
                    grid, block = _grid(lo, spacing, t0, brick, domain, normalize), batch.column("block")[0].as_py()
                    batch = batch.filter(found.is_null())
                waiting.append(batch.select(carried))
                if grid is None:  # the brick is sorted to the front, so nothing waits long
                    continue
                for left in waiting:
                    for first in range(0, left.num_rows, at_once):
                        got = some(grid, block, left.slice(first, at_once))
                        yield from (got.slice(low, OUT_ROWS) for low in range(0, got.num_rows, OUT_ROWS))
                waiting = []

        return advance

    carried = ["seed_id", "x", "y", "z", "t", "seq", "h", "px", "py", "pz"]
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    round_ = 0
    while True:
        if max_rounds is not None and round_ >= max_rounds:
            raise RuntimeError(f"{active.count()} particles still travel after {max_rounds} rounds")
        crowds = active.groupBy("block").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))  # a row a block
        split = active.join(crowds, "block").withColumn("part", F.pmod(F.xxhash64("seed_id"), "parts").cast("int")).drop("parts")
        copies = stored.join(crowds, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        copies = copies.select("block", "part", F.struct(*(c for c in stored.columns if c != "block")).alias("brick"))
        both = split.unionByName(copies, allowMissingColumns=True).withColumn("particle", F.col("brick").isNull())
        both = both.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "particle")
        moved = both.groupBy("block", "part").applyInArrow(advance_in(round_), _MOVED)
        moved = shared_table(moved, "round")
        points = moved if points is None else points.unionByName(moved)
        came_from = moved.where("last").select("seed_id", "x", "y", "z", "t", "seq", "h", "px", "py", "pz", F.col("block").alias("came_from"))
        active = keyed(came_from).where("block <> came_from").drop("came_from")
        round_ += 1
        if active.isEmpty():
            break
    return points.select(*(c.split()[0] for c in _POINTS.split(", ")), *["status"] * with_status)


def stitch(fragments: DataFrame) -> DataFrame:
    """Whole lines from the fragments of rounds: (seed_id, seq, x, y, z, t), renumbered without gaps."""
    from pyspark.sql import Window

    w = Window.partitionBy("seed_id").orderBy("round", "seq")
    return fragments.select("seed_id", (F.row_number().over(w) - 1).cast("int").alias("seq"), "x", "y", "z", "t")


def hand_offs(fragments: DataFrame) -> DataFrame:
    """(seed_id, round, from_block, to_block) of every move of a particle between blocks."""
    from pyspark.sql import Window

    ends = fragments.groupBy("seed_id", "round", "block").agg(F.count("*").alias("steps"))
    w = Window.partitionBy("seed_id").orderBy("round")
    return ends.select("seed_id", "round", F.lag("block").over(w).alias("from_block"), F.col("block").alias("to_block"), "steps").where("from_block IS NOT NULL")
