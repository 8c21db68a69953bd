"""Particles and seeds that arrive as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..field import FlowField
from ..plans.kernel import step
from ..plans.tracing import dense_grid, streamlines
from ..schema import Integration, Order


def stream_streamlines(field: FlowField, seeds: DataFrame, options: Integration = Integration(), max_points: int = 1000) -> DataFrame:
    """Streamlines of the seeds of a stream, micro-batch by micro-batch; no state is kept."""
    return streamlines(field, seeds, options=options, max_points=max_points)


def seeds_by_window(seeds: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Seeds counted by tumbling windows of event time; seeds later than ``late`` are left out."""
    return seeds.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n_seeds")).select("window.start", "window.end", "n_seeds")


def live_particles(field: FlowField, events: DataFrame, h: float = 1.0, life: int = 200, order: Order = Order.FOURTH) -> DataFrame:
    """Incremental pathlines with the living particles as state.

    ``events`` (seed_id, x, y, z): the first event of a seed injects it there;
    every later one (coordinates ignored) moves it one increment.  A particle
    outside the domain or beyond ``life`` increments ends and its state goes.
    Output: seed_id, age, x, y, z, t, alive.
    """
    grid = events.sparkSession.sparkContext.broadcast(dense_grid(field))

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        g, out = grid.value, []
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                if not state.exists:
                    age, p, t, ok = 0, np.array([[row.x, row.y, row.z]], float), g.t0, True
                else:
                    age, x, y, z, t = state.get
                    p, inside, _ = step(g.sample, order, np.array([[x, y, z]]), np.array([t]), np.array([h]), np.array([1.0]), np.array([key[0]]))
                    age, t, ok = age + 1, t + h, bool(inside[0])
                ok = ok and age <= life
                out.append((key[0], age, *map(float, p[0]), t, ok))
                if ok:
                    state.update((age, *map(float, p[0]), t))
                elif state.exists:
                    state.remove()
        yield pd.DataFrame(out, columns=["seed_id", "age", "x", "y", "z", "t", "alive"])

    return events.groupBy("seed_id").applyInPandasWithState(
        advance, "seed_id long, age int, x double, y double, z double, t double, alive boolean", "age int, x double, y double, z double, t double", "append", GroupStateTimeout.NoTimeout
    )
