"""Dense binary fields: float32 triples, x fastest, with or without a header of three int32.

``VecDataSource`` registers as format "vec": partitions are slabs of z of a step,
and filters on t, k, j and i narrow the steps, slabs and rows that are read at all.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..field import FlowField
from ..schema import NODES

#: Nodes of a partition: about 24 MB of values.
SLAB_NODES = 1 << 21


def header(path: str, endian: str = "<") -> tuple[int, int, int]:
    with open(path, "rb") as f:
        return tuple(int(v) for v in np.frombuffer(f.read(12), f"{endian}i4"))


def read_box(path: str, dims: Sequence[int], lo: Sequence[int], hi: Sequence[int], offset: int = 12, endian: str = "<") -> np.ndarray:
    """(nz, ny, nx, 3) values of an inclusive box; only the pages of its rows are touched."""
    nx, ny, nz = dims
    data = np.memmap(path, f"{endian}f4", "r", offset, (nz, ny, nx, 3))
    return np.array(data[lo[2] : hi[2] + 1, lo[1] : hi[1] + 1, lo[0] : hi[0] + 1], np.float32)


class _Slab(InputPartition):
    def __init__(self, path: str, t: int, lo: tuple, hi: tuple):
        self.path, self.t, self.lo, self.hi = path, t, lo, hi


class _VecReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = [p for p in options.get("files", options.get("path", "")).split(";") if p]
        self.endian = options.get("endian", "<")
        dims = options.get("dims")
        self.offset = 0 if dims else 12
        self.dims = tuple(map(int, dims.split(","))) if dims else header(self.files[0], self.endian)
        self.lo = list(map(int, options.get("min", "0,0,0").split(",")))
        self.hi = list(map(int, options["max"].split(","))) if "max" in options else [n - 1 for n in self.dims]
        self.t0, self.t1 = int(options.get("min_t", 0)), int(options.get("max_t", -1))
        self.none = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "t" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.t0 = max(self.t0, int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    last = int(f.value) - isinstance(f, LessThan)
                    self.t1 = last if self.t1 < 0 else min(self.t1, last)
                    self.none |= last < 0
            elif name in ("i", "j", "k") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                a = "ijk".index(name)
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.lo[a] = max(self.lo[a], int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.hi[a] = min(self.hi[a], int(f.value) - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        if self.none or any(a > b for a, b in zip(self.lo, self.hi, strict=True)):
            return []
        plane = (self.hi[0] - self.lo[0] + 1) * (self.hi[1] - self.lo[1] + 1)
        thick = max(1, SLAB_NODES // plane)
        for t, path in enumerate(self.files):
            if t < self.t0 or (self.t1 >= 0 and t > self.t1):
                continue
            if not os.path.exists(path):
                warnings.warn(f"{path} can't be read: step {t} is left out", stacklevel=2)
                continue
            for k in range(self.lo[2], self.hi[2] + 1, thick):
                out.append(_Slab(path, t, (self.lo[0], self.lo[1], k), (self.hi[0], self.hi[1], min(k + thick - 1, self.hi[2]))))
        return out

    def read(self, partition: _Slab) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        v = read_box(partition.path, self.dims, partition.lo, partition.hi, self.offset, self.endian).astype(float)
        k, j, i = (a.ravel().astype(np.int32) + partition.lo[n] for a, n in zip(np.indices(v.shape[:3]), (2, 1, 0), strict=True))
        u, w, x = np.ascontiguousarray(v.reshape(-1, 3).T)
        t = np.full(len(u), partition.t, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in (t, i, j, k)] + [pa.array(a) for a in (u, w, x)], names=["t", "i", "j", "k", "u", "v", "w"])


class VecDataSource(DataSource):
    """Options: path or files (";" between), dims ("nx,ny,nz": no header), min, max, min_t, max_t, endian."""

    @classmethod
    def name(cls) -> str:
        return "vec"

    def schema(self) -> str:
        return NODES

    def reader(self, schema) -> DataSourceReader:
        return _VecReader(dict(self.options))


def _load(spark: SparkSession, files: list[str], **options) -> DataFrame:
    spark.dataSource.register(VecDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("vec").option("files", ";".join(files))
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, ",".join(map(str, v)) if isinstance(v, (tuple, list)) else str(v))
    return reader.load()


def read_vec(spark: SparkSession, path: str, dims: Sequence[int] | None = None, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None, endian: str = "<") -> FlowField:
    """A static field, whole or an inclusive box of it (whose bounds stay in the whole's index space)."""
    shape = tuple(dims) if dims else header(path, endian)
    nodes = _load(spark, [path], dims=dims, min=lo, max=hi, endian=endian)
    if lo is None:
        return FlowField.of(nodes, shape)
    from pyspark.sql import functions as F

    nodes = nodes.withColumns({c: F.col(c) - int(a) for c, a in zip("ijk", lo, strict=True)})
    size = tuple(b - a + 1 for a, b in zip(lo, hi, strict=True))
    return FlowField.of(nodes, size, tuple(map(float, lo)), tuple(map(float, hi)))


def read_series(spark: SparkSession, listing, lo: Sequence[int] | None = None, hi: Sequence[int] | None = None, min_t: int = 0, max_t: int = -1, endian: str = "<") -> FlowField:
    """A time series of a ``FieldList``; unreadable files are left out of the table.  The list's scale is applied."""
    from pyspark.sql import functions as F

    from ..operators.transform import scale_field

    shape = listing.dims or header(next(f for f in listing.files if os.path.exists(f)), endian)
    nodes = _load(spark, listing.files, dims=listing.dims, min=lo, max=hi, min_t=min_t, max_t=max_t, endian=endian)
    last = len(listing.files) - 1 if max_t < 0 else max_t
    if lo is not None:
        nodes = nodes.withColumns({c: F.col(c) - int(a) for c, a in zip("ijk", lo, strict=True)})
        shape = tuple(b - a + 1 for a, b in zip(lo, hi, strict=True))
        out = FlowField.of(nodes, shape, tuple(map(float, lo)), tuple(map(float, hi)), (min_t, last))
    else:
        out = FlowField.of(nodes, shape, t_range=(min_t, last))
    return scale_field(out, listing.scale) if listing.scale != 1.0 else out


def read_gaussian(spark: SparkSession, mean: str, deviation: str) -> FlowField:
    """A static uncertain field from a file of means and one of standard deviations."""
    from pyspark.sql import functions as F

    m, s = read_vec(spark, mean), read_vec(spark, deviation)
    spread = s.nodes.select("i", "j", "k", *(F.col(c).alias(f"s{c}") for c in "uvw"))
    return m.with_nodes(m.nodes.join(spread, ["i", "j", "k"]).select("t", "i", "j", "k", "u", "v", "w", "su", "sv", "sw"))


def write_vec(field: FlowField, path: str, with_header: bool = True, t: int | None = None) -> None:
    """One step as a binary file.  Slabs of z are written by their tasks at their own offsets."""
    nx, ny, nz = field.dims
    start = 12 if with_header else 0
    with open(path, "wb") as f:
        if with_header:
            f.write(np.array(field.dims, "<i4").tobytes())
        f.truncate(start + nx * ny * nz * 12)
    step = field.t_range[0] if t is None else t

    def write(key: tuple, table: pa.Table) -> pa.Table:
        k = int(key[0].as_py())
        plane = np.zeros((ny, nx, 3), "<f4")
        plane[table.column("j").to_numpy(), table.column("i").to_numpy()] = np.stack([table.column(c).to_numpy() for c in "uvw"], 1)
        with open(path, "r+b") as f:
            f.seek(start + k * nx * ny * 12)
            f.write(plane.tobytes())
        return pa.table({"k": pa.array([k], pa.int32())})

    from pyspark.sql import functions as F

    rows = field.nodes.where(F.col("t") == step).select("i", "j", "k", *(F.col(c).cast("float").alias(c) for c in "uvw"))
    rows.groupBy("k").applyInArrow(write, "k int").count()


def raw_to_vec(source: str, target: str, dims: Sequence[int]) -> None:
    """Add the header to a file without one, in pieces."""
    with open(source, "rb") as a, open(target, "wb") as b:
        b.write(np.array(dims, "<i4").tobytes())
        while part := a.read(1 << 24):
            b.write(part)


def vec_to_raw(source: str, target: str) -> tuple[int, int, int]:
    """Drop the header; returns the dims."""
    with open(source, "rb") as a, open(target, "wb") as b:
        dims = tuple(int(v) for v in np.frombuffer(a.read(12), "<i4"))
        while part := a.read(1 << 24):
            b.write(part)
    return dims


def swap_bytes(data: bytes, width: int) -> bytes:
    """Reverse the byte order of 2-, 4- or 8-byte words."""
    return np.frombuffer(data, f"u{width}").byteswap().tobytes()
