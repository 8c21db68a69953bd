"""Solution, grid, mesh, partition and trajectory files; NetCDF classic; legacy VTK; volumes with headers."""

from __future__ import annotations

import os
import struct
from collections.abc import Sequence
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..field import FlowField
from ..operators.transform import momentum_to_velocity
from ..schema import NODES, DataMode
from .binary import read_series, read_vec
from .lists import read_list

#: Text files are read and written whole, up to so many bytes.
FILE_BYTES = 256 << 20


def _dims_of(path: str, endian: str) -> tuple[int, int, int]:
    with open(path, "rb") as f:
        return tuple(int(v) for v in np.frombuffer(f.read(12), f"{endian}i4"))


def _planes(spark: SparkSession, path: str, dims: Sequence[int], skip: int, names: Sequence[str], endian: str) -> DataFrame:
    """Files of one plane of float32 a variable, all nodes each: (i, j, k, <names>), a task a z slab."""
    nx, ny, nz = dims
    n = nx * ny * nz

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                data = np.memmap(path, f"{endian}f4", "r", skip, (len(names), n))
                part = np.array(data[:, k * nx * ny : (k + 1) * nx * ny], float)
                j, i = (a.ravel().astype(np.int32) for a in np.indices((ny, nx)))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.full(nx * ny, k, np.int32)), *(pa.array(p) for p in part)], names=["i", "j", "k", *names])

    return spark.range(nz).repartition(max(1, min(nz, 256)), "id").mapInArrow(run, "i int, j int, k int, " + ", ".join(f"{c} double" for c in names))


def read_plot3d_solution(spark: SparkSession, path: str, endian: str = "<") -> FlowField:
    """dims, four reference values, then density, three momenta and energy: velocities, zero where the density is."""
    dims = _dims_of(path, endian)
    rows = _planes(spark, path, dims, 28, ["rho", "mx", "my", "mz", "energy"], endian)
    return FlowField.of(momentum_to_velocity(rows).select(F.lit(0).alias("t"), "i", "j", "k", "u", "v", "w"), dims)


def read_plot3d_grid(spark: SparkSession, path: str, endian: str = "<") -> tuple[DataFrame, tuple[int, int, int]]:
    """dims, then all x, all y, all z: curvilinear vertices (i, j, k, x, y, z)."""
    dims = _dims_of(path, endian)
    return _planes(spark, path, dims, 12, ["x", "y", "z"], endian), dims


def read_tet_mesh(spark: SparkSession, nodes_path: str, tets_path: str, endian: str = "<", first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(vertices, tets) of a node file (counts of nodes, surface triangles and tets, then x, y and z
    planes) and a file of four int32 a tetrahedron; ``first`` is the number of the first vertex."""
    n, _, m = _dims_of(nodes_path, endian)

    def vertices(batches):
        for batch in batches:
            for b in batch.column("id").to_pylist():
                data = np.memmap(nodes_path, f"{endian}f4", "r", 12, (3, n))
                a, z = b << 16, min((b + 1) << 16, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, z)), *(pa.array(np.array(data[c, a:z], float)) for c in range(3))], names=["vid", "x", "y", "z"])

    def tets(batches):
        for batch in batches:
            for b in batch.column("id").to_pylist():
                data = np.memmap(tets_path, f"{endian}i4", "r", 0, (m, 4))
                a, z = b << 16, min((b + 1) << 16, m)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, z)), *(pa.array(np.array(data[a:z, c], np.int64) - first) for c in range(4))], names=["tid", "v0", "v1", "v2", "v3"])

    return spark.range((n + 65535) >> 16).mapInArrow(vertices, "vid long, x double, y double, z double"), spark.range((m + 65535) >> 16).mapInArrow(tets, "tid long, v0 long, v1 long, v2 long, v3 long")


def load_base(spark: SparkSession, base: str, kind: str, endian: str = "<"):
    """``<base>.soln`` with ``<base>.grid`` ("curvilinear") or ``<base>.grid`` and ``<base>.tetra`` ("irregular")."""
    if kind == "curvilinear":
        vertices, dims = read_plot3d_grid(spark, f"{base}.grid", endian)
        return read_plot3d_solution(spark, f"{base}.soln", endian), vertices, dims
    return read_plot3d_solution(spark, f"{base}.soln", endian), *read_tet_mesh(spark, f"{base}.grid", f"{base}.tetra", endian)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """Blocks (gid, proc, lo_x.. hi_t) of a partition file: int32 dims[4], processes, blocks, time
    parts, block size[4], an owner a block, then float32 min and max of x, y, z, t a block."""
    with open(path, "rb") as f:
        data = f.read()
    head = np.frombuffer(data, "<i4", 11)
    n = int(head[5])
    owners = np.frombuffer(data, "<i4", n, 44)
    extents = np.frombuffer(data, "<f4", 8 * n, 44 + 4 * n).reshape(n, 2, 4)
    rows = [(g, int(owners[g]), *map(int, extents[g].ravel())) for g in range(n)]
    return spark.createDataFrame(rows, "gid int, proc int, " + ", ".join(f"{s}_{p} int" for s in ("lo", "hi") for p in "xyzt"))


def write_partition(path: str, dims: Sequence[int], n_procs: int, time_parts: int, block_size: Sequence[int], blocks: Sequence[Sequence[int]]) -> None:
    """``blocks``: (gid, proc, lo x 4, hi x 4) rows in gid order."""
    with open(path, "wb") as f:
        f.write(np.array([*dims, n_procs, len(blocks), time_parts, *block_size], "<i4").tobytes())
        f.write(np.array([b[1] for b in blocks], "<i4").tobytes())
        f.write(np.array([b[2:] for b in blocks], "<f4").tobytes())


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """(seed_id, seq, x, y, z, t) of a trajectory file: float32 min[4] and max[4], int32 counts,
    -1, then all points.  Tasks read runs of lines."""
    with open(path, "rb") as f:
        f.seek(32)
        counts: list[int] = []
        while True:
            part = np.frombuffer(f.read(1 << 16), "<i4")
            stop = np.flatnonzero(part == -1)
            counts += part[: stop[0] if len(stop) else None].tolist()
            if len(stop) or not len(part):
                break
    base = 32 + 4 * (len(counts) + 1)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def run(batches):
        for batch in batches:
            for b in batch.column("id").to_pylist():
                a, z = b * 1024, min((b + 1) * 1024, len(counts))
                rows = np.fromfile(path, "<f4", int(ends[z] - ends[a]) * 4, offset=base + int(ends[a]) * 16).reshape(-1, 4).astype(float)
                n = np.diff(ends[a : z + 1])
                line = np.repeat(np.arange(a, z), n)
                seq = np.arange(len(rows)) - np.repeat(ends[a:z] - ends[a], n)
                yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(seq.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["seed_id", "seq", "x", "y", "z", "t"])

    return spark.range((len(counts) + 1023) // 1024).mapInArrow(run, "seed_id long, seq int, x double, y double, z double, t double")


def write_trajectories(points: DataFrame, path: str, lo: Sequence[float], hi: Sequence[float], sidecar: str | None = None) -> int:
    """Write lines (seed_id, dir, seq, x, y, z, t) to one file; returns their number.

    Offsets are prefix sums over the lines' counts; each task writes its lines at
    their offsets.  ``sidecar`` gets the lines' seed ids as int64.  ``path`` is a
    folder that all executors share.
    """
    from ..operators.lines import writer_offsets

    offsets = writer_offsets(points)
    counts = offsets.orderBy("first").select("seed_id", "n_points").toArrow()  # one count a line is the file's header
    n = counts.column("n_points").to_numpy()
    base = 32 + 4 * (len(n) + 1)
    with open(path, "wb") as f:
        f.write(np.array([*lo, *hi], "<f4").tobytes() + np.append(n, -1).astype("<i4").tobytes())
        f.truncate(base + int(n.sum()) * 16)
    if sidecar:
        counts.column("seed_id").to_numpy().astype("<i8").tofile(sidecar)

    def write(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = (batch.column("first").to_numpy() + batch.column("seq").to_numpy()) * 16 + base
            rows = np.stack([batch.column(c).to_numpy() for c in "xyzt"], 1).astype("<f4")
            order = np.argsort(at)
            at, rows = at[order], rows[order]
            cuts = np.flatnonzero(np.diff(at) != 16) + 1
            with open(path, "r+b") as f:
                for a, z in zip(np.append(0, cuts).tolist(), np.append(cuts, len(at)).tolist(), strict=True):
                    f.seek(int(at[a]))
                    f.write(rows[a:z].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    points.join(offsets.select("seed_id", "dir", "first"), ["seed_id", "dir"]).select("seq", "x", "y", "z", "t", "first").mapInArrow(write, "n long").count()
    return len(n)


def write_volume(df: DataFrame, dims: Sequence[int], column: str, path: str) -> None:
    """A scalar (i, j, k, column) as raw float32 at ``path``.raw and its text header at ``path``.nhdr."""
    nx, ny, nz = dims
    with open(f"{path}.raw", "wb") as f:
        f.truncate(nx * ny * nz * 4)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        k = int(key[0].as_py())
        plane = np.zeros((ny, nx), "<f4")
        plane[table.column("j").to_numpy(), table.column("i").to_numpy()] = table.column(column).to_numpy()
        with open(f"{path}.raw", "r+b") as f:
            f.seek(k * nx * ny * 4)
            f.write(plane.tobytes())
        return pa.table({"k": pa.array([k], pa.int32())})

    df.select("i", "j", "k", column).groupBy("k").applyInArrow(write, "k int").count()
    name = path.rsplit("/", 1)[-1]
    with open(f"{path}.nhdr", "w", encoding="ascii") as f:
        f.write(f"NRRD0004\ntype: float\ndimension: 3\nsizes: {nx} {ny} {nz}\nencoding: raw\nendian: little\ndata file: {name}.raw\n")


def read_volume(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(i, j, k, column) of a volume that ``write_volume`` wrote, a task a z slab."""
    with open(f"{path}.nhdr", encoding="ascii") as f:
        lines = dict(line.strip().split(": ", 1) for line in f if ": " in line)
    dims = tuple(map(int, lines["sizes"].split()))
    return _planes(spark, os.path.join(os.path.dirname(path), lines["data file"]), dims, 0, [column], "<")


_NC_WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8}
_NC_KIND = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf_variables(path: str) -> dict[str, tuple[str, tuple[int, ...], int]]:
    """(number type, shape, offset) of the variables of a NetCDF classic file (versions 1 and 2, fixed dimensions); reads its header alone."""
    with open(path, "rb") as f:
        if (magic := f.read(4))[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("not a NetCDF classic file")
        number = lambda: struct.unpack(">i", f.read(4))[0]

        def text() -> str:
            n = number()
            return f.read((n + 3) // 4 * 4)[:n].decode()

        def attributes() -> None:
            number()
            for _ in range(number()):
                text()
                k, n = number(), number()
                f.seek((n * _NC_WIDTH[k] + 3) // 4 * 4, 1)

        number()
        number()
        dims = [(text(), number()) for _ in range(number())]
        attributes()
        found = {}
        number()
        for _ in range(number()):
            name = text()
            shape = tuple(dims[number()][1] for _ in range(number()))
            attributes()
            k = number()
            number()
            begin = struct.unpack(">i", f.read(4))[0] if magic[3] == 1 else struct.unpack(">q", f.read(8))[0]
            found[name] = (_NC_KIND[k], shape, begin)
        return found


def _netcdf_part(path: str, kind: str, shape: Sequence[int], begin: int, order: str, k: int) -> np.ndarray:
    """The (ny, nx) plane at z = k of a variable whose axes are stored in ``order``; axes of length 1 beyond three are dropped."""
    data = np.memmap(path, kind, "r", begin, tuple(shape))
    data = data.reshape([n for n in shape if n > 1] if len(shape) > 3 else shape)
    return np.array(np.transpose(data, [order.index(c) for c in "zyx"])[k], float)


def read_netcdf(path: str, names: Sequence[str | None], fills: Sequence[float | None] = (None, None, None), order: str = "zyx") -> np.ndarray:
    """(nz, ny, nx, 3) velocities of a NetCDF classic file; a name of None gives zeros, fill values become zero, ``order`` names the stored axes."""
    found = netcdf_variables(path)
    one = next(v for n, v in found.items() if n in names)
    dims = [n for n in one[1] if n > 1] if len(one[1]) > 3 else one[1]
    nz = dims[order.index("z")]
    planes = [_netcdf_planes(path, found, names, fills, order, k) for k in range(nz)]
    return np.stack(planes)


def _netcdf_planes(path: str, found: dict, names: Sequence[str | None], fills: Sequence[float | None], order: str, k: int) -> np.ndarray:
    parts = [None if n in (None, "NULL") else _netcdf_part(path, *found[n], order, k) for n in names]
    zero = np.zeros_like(next(p for p in parts if p is not None))
    return np.stack([zero if p is None else np.where(p == fill, 0.0, p) if fill is not None else p for p, fill in zip(parts, fills, strict=True)], -1)


def read_netcdf_field(spark: SparkSession, path: str, names: Sequence[str | None], fills: Sequence[float | None] = (None, None, None), order: str = "zyx") -> FlowField:
    """As ``read_netcdf``, as a field: the driver reads the header, tasks the planes of their z."""
    found = netcdf_variables(path)
    shape = next(v for n, v in found.items() if n in names)[1]
    sizes = [n for n in shape if n > 1] if len(shape) > 3 else shape
    nx, ny, nz = (sizes[order.index(c)] for c in "xyz")

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                v = _netcdf_planes(path, found, names, fills, order, k).reshape(-1, 3)
                j, i = (a.ravel().astype(np.int32) for a in np.indices((ny, nx)))
                full = lambda n: pa.array(np.full(nx * ny, n, np.int32))
                yield pa.RecordBatch.from_arrays([full(0), pa.array(i), pa.array(j), full(k), *(pa.array(np.ascontiguousarray(c)) for c in v.T)], names=["t", "i", "j", "k", "u", "v", "w"])

    return FlowField.of(spark.range(nz).repartition(max(1, min(nz, 256)), "id").mapInArrow(run, NODES), (nx, ny, nz))


def write_netcdf(field: FlowField, path: str, names: Sequence[str] = ("u", "v", "w")) -> None:
    """The first step as a NetCDF classic file with axes z, y, x and float32 variables (fields of checked size)."""
    v = _dense(field)
    text = lambda s: struct.pack(">i", len(s)) + s.encode().ljust((len(s) + 3) // 4 * 4, b"\0")
    head = b"CDF\x02" + struct.pack(">iii", 0, 10, 3) + b"".join(text(c) + struct.pack(">i", n) for c, n in zip("zyx", v.shape[:3], strict=True)) + struct.pack(">iiii", 0, 0, 11, len(names))
    size = v[..., 0].size * 4
    fixed = lambda n: text(n) + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">iiii", 0, 0, 5, size)
    begin = len(head) + sum(len(fixed(n)) + 8 for n in names)
    with open(path, "wb") as f:
        f.write(head + b"".join(fixed(n) + struct.pack(">q", begin + c * size) for c, n in enumerate(names)))
        for c in range(len(names)):
            f.write(v[..., c].astype(">f4").tobytes())


def _dense(field: FlowField) -> np.ndarray:
    """(nz, ny, nx, 3) of the first step on the driver, refused above ``FILE_BYTES``."""
    if field.size_bytes() > FILE_BYTES:
        raise ValueError("the field is too large for a text or NetCDF file; write binary files")
    return field.to_numpy()[0]


def write_vti(field: FlowField, path: str) -> None:
    """An XML image file with one vector array on points (fields of checked size)."""
    v = _dense(field)
    extent = " ".join(f"0 {n - 1}" for n in field.dims)
    origin, spacing = (" ".join(f"{x:.17g}" for x in a) for a in (field.lo, field.spacing))
    with open(path, "w", encoding="ascii") as f:
        f.write(f'<VTKFile type="ImageData" version="0.1">\n<ImageData WholeExtent="{extent}" Origin="{origin}" Spacing="{spacing}">\n<Piece Extent="{extent}">\n')
        f.write('<PointData Vectors="velocity">\n<DataArray type="Float64" Name="velocity" NumberOfComponents="3" format="ascii">\n')
        np.savetxt(f, v.reshape(-1, 3), fmt="%.17g")
        f.write("</DataArray>\n</PointData>\n</Piece>\n</ImageData>\n</VTKFile>\n")


def write_vts(field: FlowField, vertices: DataFrame, path: str) -> None:
    """An XML structured-grid file: explicit vertices (i, j, k, x, y, z) and one vector array (fields of checked size)."""
    v = _dense(field)
    at = FlowField.of(vertices.select(F.lit(0).alias("t"), "i", "j", "k", F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w")), field.dims).to_numpy()[0]
    extent = " ".join(f"0 {n - 1}" for n in field.dims)
    with open(path, "w", encoding="ascii") as f:
        f.write(f'<VTKFile type="StructuredGrid" version="0.1">\n<StructuredGrid WholeExtent="{extent}">\n<Piece Extent="{extent}">\n')
        f.write('<PointData Vectors="velocity">\n<DataArray type="Float64" Name="velocity" NumberOfComponents="3" format="ascii">\n')
        np.savetxt(f, v.reshape(-1, 3), fmt="%.17g")
        f.write('</DataArray>\n</PointData>\n<Points>\n<DataArray type="Float64" NumberOfComponents="3" format="ascii">\n')
        np.savetxt(f, at.reshape(-1, 3), fmt="%.17g")
        f.write("</DataArray>\n</Points>\n</Piece>\n</StructuredGrid>\n</VTKFile>\n")


def _xml_arrays(path: str, kind: str) -> tuple[ElementTree.Element, tuple[int, int, int], dict[str, np.ndarray]]:
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError("the file is too large to be parsed as text")
    grid = ElementTree.parse(path).getroot().find(kind)
    extent = list(map(int, grid.get("WholeExtent").split()))
    dims = tuple(extent[2 * a + 1] - extent[2 * a] + 1 for a in range(3))
    piece = grid.find("Piece")
    arrays = {part: np.array(piece.find(part).find("DataArray").text.split(), float).reshape(dims[2], dims[1], dims[0], 3) for part in ("PointData", "Points") if piece.find(part) is not None}
    return grid, dims, arrays


def read_vti(spark: SparkSession, path: str) -> FlowField:
    """An XML image file with inline text and one vector array on points (files of checked size)."""
    grid, dims, arrays = _xml_arrays(path, "ImageData")
    origin, spacing = (list(map(float, grid.get(a).split())) for a in ("Origin", "Spacing"))
    return FlowField.from_numpy(spark, arrays["PointData"], lo=tuple(origin), hi=tuple(o + s * (n - 1) for o, s, n in zip(origin, spacing, dims, strict=True)))


def read_vts(spark: SparkSession, path: str) -> tuple[FlowField, DataFrame]:
    """An XML structured-grid file: the field in index space, and its vertices (i, j, k, x, y, z)."""
    _, _, arrays = _xml_arrays(path, "StructuredGrid")
    places = FlowField.from_numpy(spark, arrays["Points"]).nodes
    return FlowField.from_numpy(spark, arrays["PointData"]), places.select("i", "j", "k", F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("z"))


def read_field(spark: SparkSession, path: str, mode: DataMode | str, **options) -> FlowField:
    """A field by its mode: RAW and RAW_HEADER name a list of files (or one ``.vec`` file), NETCDF
    a file, with ``names`` and, if need be, ``fills`` and ``order``."""
    mode = DataMode(mode)
    if mode is DataMode.NETCDF:
        return read_netcdf_field(spark, path, **options)
    if path.endswith((".vec", ".raw")):
        return read_vec(spark, path, **options)
    listing = read_list(path)
    if listing.mode != mode.value:
        raise ValueError(f"the list names files of mode {listing.mode}")
    return read_series(spark, listing, **options)


def read_vtk(spark: SparkSession, path: str) -> FlowField:
    """A legacy ASCII image file with one vector array on points (files of checked size)."""
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError("the file is too large to be parsed as text")
    with open(path, encoding="ascii") as f:
        words = f.read().split()
    upper = [w.upper() for w in words]
    value = lambda key, n: [float(w) for w in words[upper.index(key) + 1 : upper.index(key) + 1 + n]]
    dims = tuple(int(v) for v in value("DIMENSIONS", 3))
    origin = value("ORIGIN", 3) if "ORIGIN" in upper else [0.0] * 3
    spacing = value("SPACING", 3) if "SPACING" in upper else [1.0] * 3
    start = upper.index("VECTORS") + 3
    v = np.array(words[start : start + 3 * dims[0] * dims[1] * dims[2]], float).reshape(dims[2], dims[1], dims[0], 3)
    return FlowField.from_numpy(spark, v, lo=tuple(origin), hi=tuple(o + s * (n - 1) for o, s, n in zip(origin, spacing, dims, strict=True)))


def write_vtk(field: FlowField, path: str) -> None:
    """A legacy ASCII image file (fields of checked size)."""
    v = _dense(field)
    nx, ny, nz = field.dims
    with open(path, "w", encoding="ascii") as f:
        f.write(f"# vtk DataFile Version 3.0\nfield\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} {nz}\n")
        f.write("ORIGIN {:.9g} {:.9g} {:.9g}\nSPACING {:.9g} {:.9g} {:.9g}\n".format(*field.lo, *field.spacing))
        f.write(f"POINT_DATA {nx * ny * nz}\nVECTORS velocity double\n")
        np.savetxt(f, v.reshape(-1, 3), fmt="%.17g")
