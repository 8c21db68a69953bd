"""SQL surface: fields as views (``FlowField.as_view``) and tracers as table functions.

    register_streamlines(spark, field, "streamlines", options)
    SELECT s.seed_id, l.* FROM seeds s, LATERAL streamlines(s.x, s.y, s.z) l

A table function is called once a seed; for many seeds ``plans.tracing.streamlines``
traces them in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .field import FlowField
from .plans.kernel import STATUS, trace
from .plans.tracing import dense_grid
from .schema import Direction, Integration


def register_streamlines(spark: SparkSession, field: FlowField, name: str = "streamlines", options: Integration = Integration(), max_points: int = 1000, direction: Direction = Direction.FORWARD) -> None:
    """A table function ``name(x, y, z)`` that returns the points (dir, seq, x, y, z, status) of the
    line through a place; none where it is null, outside or at rest.  The field has to fit the broadcast."""
    grid = spark.sparkContext.broadcast(dense_grid(field))
    signs = [s for bit, s in ((Direction.BACKWARD, -1.0), (Direction.FORWARD, 1.0)) if direction & bit]

    class Streamlines:
        def eval(self, x: float, y: float, z: float) -> Iterator[tuple]:
            if x is None or y is None or z is None:
                return
            g = grid.value
            for sign in signs:
                row, seq, place, _, state = trace(g, np.array([[x, y, z]], float), np.array([g.t0]), np.array([sign]), np.zeros(1, np.int64), options, max_points)
                for k in np.argsort(seq).tolist():
                    yield (int(sign), int(seq[k]), *map(float, place[k]), STATUS[state[0]])

    spark.udtf.register(name, udtf(Streamlines, returnType="dir int, seq int, x double, y double, z double, status string"))
