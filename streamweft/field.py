"""A flow field: node values in a DataFrame and a small grid description."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import NODES

Triple = tuple[float, float, float]


@dataclass(frozen=True)
class FlowField:
    """``nodes`` has (t, i, j, k, u, v, w) and for an uncertain field (su, sv, sw).

    ``lo``/``hi`` bound lookups, ``real_lo``/``real_hi`` (without ghost cells)
    end traces.  Node ids are ``k * nx * ny + j * nx + i``.
    """

    nodes: DataFrame
    dims: tuple[int, int, int]
    lo: Triple
    hi: Triple
    real_lo: Triple
    real_hi: Triple
    t_range: tuple[int, int] = (0, 0)
    normalized: bool = False

    @staticmethod
    def of(nodes: DataFrame, dims: tuple[int, int, int], lo: Triple | None = None, hi: Triple | None = None, t_range: tuple[int, int] = (0, 0)) -> FlowField:
        """Bounds default to index space."""
        lo = lo or (0.0, 0.0, 0.0)
        hi = hi or tuple(float(n - 1) for n in dims)
        return FlowField(nodes, tuple(dims), lo, hi, lo, hi, tuple(t_range))

    @staticmethod
    def from_numpy(spark: SparkSession, values: np.ndarray, **grid) -> FlowField:
        """``values``: (nz, ny, nx, 3) or (nt, nz, ny, nx, 3)."""
        values = values if values.ndim == 5 else values[None]
        nt, nz, ny, nx, _ = values.shape
        t, k, j, i = (a.ravel().astype(np.int32) for a in np.indices((nt, nz, ny, nx)))
        u, v, w = values.reshape(-1, 3).T.astype(float)
        table = pa.table({"t": t, "i": i, "j": j, "k": k, "u": u, "v": v, "w": w})
        return FlowField.of(spark.createDataFrame(table, NODES), (nx, ny, nz), t_range=(0, nt - 1), **grid)

    @property
    def spacing(self) -> Triple:
        return tuple((h - l) / (n - 1) if n > 1 else 1.0 for l, h, n in zip(self.lo, self.hi, self.dims, strict=True))

    @property
    def time_varying(self) -> bool:
        return self.t_range[1] > self.t_range[0]

    def with_nodes(self, nodes: DataFrame, **changes) -> FlowField:
        return replace(self, nodes=nodes, **changes)

    def with_bounds(self, lo: Triple, hi: Triple, real_lo: Triple | None = None, real_hi: Triple | None = None) -> FlowField:
        return replace(self, lo=lo, hi=hi, real_lo=real_lo or lo, real_hi=real_hi or hi)

    def size_bytes(self) -> int:
        """Bytes of the dense values, known without a job."""
        nx, ny, nz = self.dims
        return nx * ny * nz * (self.t_range[1] - self.t_range[0] + 1) * 24

    def to_numpy(self) -> np.ndarray:
        """Dense (nt, nz, ny, nx, 3) values; missing nodes are zero.  For fields of checked size only."""
        nx, ny, nz = self.dims
        t0, t1 = self.t_range
        table = self.nodes.select("t", "i", "j", "k", "u", "v", "w").toArrow()
        out = np.zeros((t1 - t0 + 1, nz, ny, nx, 3))
        t, i, j, k = (table.column(c).to_numpy() for c in ("t", "i", "j", "k"))
        out[t - t0, k, j, i] = np.stack([table.column(c).to_numpy() for c in ("u", "v", "w")], 1)
        return out

    def as_view(self, name: str) -> None:
        """A SQL view of the nodes with ids and positions."""
        nx, ny, _ = self.dims
        node = F.col("k").cast("long") * (nx * ny) + F.col("j") * nx + F.col("i")
        at = [(F.lit(lo) + F.col(c) * s).alias(p) for c, p, lo, s in zip("ijk", "xyz", self.lo, self.spacing, strict=True)]
        self.nodes.select("*", node.alias("node"), *at).createOrReplaceTempView(name)
