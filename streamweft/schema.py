"""Enumerations, table schemas and integration settings."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum, IntEnum

NODES = "t int, i int, j int, k int, u double, v double, w double"
GAUSSIAN_NODES = NODES + ", su double, sv double, sw double"
SEEDS = "seed_id long, x double, y double, z double, t double"
TRACE_POINTS = "seed_id long, dir int, seq int, x double, y double, z double, t double"
TRACE_ROWS = TRACE_POINTS + ", status string"
GRID_VERTICES = "i int, j int, k int, x double, y double, z double"
TETS = "tid long, v0 long, v1 long, v2 long, v3 long"
AMR_BLOCKS = "t int, level int, idx long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double, has_data boolean"


class Order(Enum):
    SECOND = 2
    FOURTH = 4
    RK45 = 45


class Direction(IntEnum):
    BACKWARD = 1
    FORWARD = 2
    BOTH = 3


class Status(str, Enum):
    RUN = "RUN"
    OKAY = "OKAY"
    OUT_OF_BOUND = "OUT_OF_BOUND"
    CRITICAL = "CRITICAL"
    FAIL = "FAIL"
    MAX_POINTS = "MAX_POINTS"


class CellType(str, Enum):
    TRIANGLE = "TRIANGLE"
    CUBE = "CUBE"
    POLYGON = "POLYGON"
    TETRAHEDRON = "TETRAHEDRON"


class Axis(str, Enum):
    X = "i"
    Y = "j"
    Z = "k"


class DataMode(str, Enum):
    RAW = "RAW"
    RAW_HEADER = "RAW_HEADER"
    NETCDF = "NETCDF"


#: A velocity whose components are all below this is stationary.
STATIONARY = 1e-5


@dataclass(frozen=True)
class Integration:
    """Step control.  Angles are degrees; ``adaptive`` false keeps ``step``."""

    order: Order = Order.RK45
    step: float = 1.0
    min_step: float = 0.01
    max_step: float = 5.0
    max_error: float = 0.01
    low_angle: float = 3.0
    high_angle: float = 15.0
    adaptive: bool = True

    @staticmethod
    def from_steps(step: float, max_step: float) -> Integration:
        """Two-value settings: the smallest step is the largest one's ten-thousandth."""
        return Integration(step=step, max_step=max_step, min_step=max_step * 1e-4)

    def fixed(self, step: float) -> Integration:
        return replace(self, step=step, adaptive=False)
