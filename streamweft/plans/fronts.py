"""Streaklines and timelines: rounds over time in which seeds are injected and particles age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..field import FlowField
from ..schema import Order
from .rounds import shared_table
from .tracing import advect_interval, dense_grid

LIFE = 200


def _fronts(field: FlowField, seeds: DataFrame, step: float, every: int, life: int, cap: int | None, t_range: tuple[float, float] | None, order: Order) -> DataFrame:
    start, end = t_range or tuple(map(float, field.t_range))
    columns = ["particle", "trace_id", "born", "x", "y", "z"]
    n, alive, history, now = 0, None, None, start
    grid = seeds.sparkSession.sparkContext.broadcast(dense_grid(field))
    while now < end:
        later = min(now + step, end)
        if n % every == 0:
            fresh = seeds.select((F.lit(n).cast("long") * (1 << 32) + F.col("seed_id")).alias("particle"), F.col("seed_id").alias("trace_id"), F.lit(n).alias("born"), "x", "y", "z")
            alive = fresh if alive is None else alive.select(*columns).unionByName(fresh)
        moved = advect_interval(field, alive.withColumnRenamed("particle", "seed_id"), now, later, order, grid).where("status = 'OKAY'")
        moved = moved.select(F.col("seed_id").alias("particle"), "x", "y", "z", "t").join(alive.select("particle", "trace_id", "born"), "particle")
        moved = moved.where(F.lit(n + 1) - F.col("born") <= life)
        if cap is not None:  # the oldest beyond the cap go
            w = Window.partitionBy("trace_id").orderBy(F.desc("born"))
            moved = moved.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).drop("rank")
        n, now = n + 1, later
        alive = shared_table(moved.withColumn("step", F.lit(n)), "front")
        history = alive if history is None else history.unionByName(alive)
    if history is None:
        history = seeds.sparkSession.createDataFrame([], "particle long, x double, y double, z double, t double, trace_id long, born int, step int")
    return history.select("trace_id", "particle", "born", "step", "t", "x", "y", "z")


def streaklines(field: FlowField, seeds: DataFrame, step: float = 1.0, life: int = LIFE, cap: int | None = None, t_range: tuple[float, float] | None = None, order: Order = Order.FOURTH) -> DataFrame:
    """Every particle's place after every time increment (trace_id, particle, born, step, t, x, y, z).

    Each increment moves the living particles, ends those older than ``life``
    or outside, keeps the youngest ``cap`` a seed, and injects one particle a seed.
    """
    return _fronts(field, seeds, step, 1, life, cap, t_range, order)


def timelines(field: FlowField, seeds: DataFrame, step: float = 1.0, delay: int = 5, life: int = LIFE, t_range: tuple[float, float] | None = None, order: Order = Order.FOURTH) -> DataFrame:
    """As ``streaklines`` with an injection every ``delay`` increments; particles of one ``born`` form a front."""
    return _fronts(field, seeds, step, delay, life, None, t_range, order)


def current(front: DataFrame) -> DataFrame:
    """The particles after the last increment."""
    last = front.agg(F.max("step").alias("step"))
    return front.join(F.broadcast(last), "step")


def advance_particles(field: FlowField, particles: DataFrame, t: float, step: float, life: int = LIFE, order: Order = Order.FOURTH) -> DataFrame:
    """Incremental pathlines: living particles (seed_id, age, x, y, z) one increment on; time and
    age advance, and particles beyond ``life`` or outside end."""
    moved = advect_interval(field, particles, t, t + step, order).where("status = 'OKAY'").drop("status")
    return moved.join(particles.select("seed_id", (F.col("age") + 1).alias("age")), "seed_id").where(F.col("age") <= life)
