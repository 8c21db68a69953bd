"""Space-time decomposition: blocks, ghosts, neighbours, owners and time groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_AXES = "xyzt"


def factor_blocks(dims: Sequence[int], n: int, fixed: Sequence[int] = (0, 0, 0, 0)) -> tuple[int, ...]:
    """Blocks along each axis: the smallest prime factor left goes to the axis with the longest
    blocks, the first of equal ones; axes with a ``fixed`` number keep it."""
    counts = [f or 1 for f in fixed[: len(dims)]]
    left = n
    for f in fixed[: len(dims)]:
        if f:
            if left % f:
                raise ValueError("the fixed factors don't divide the number of blocks")
            left //= f
    free = [a for a in range(len(dims)) if not fixed[a]]
    while left > 1:
        p = next(q for q in range(2, left + 1) if left % q == 0)
        if not free:
            raise ValueError("no axis is free to split")
        axis = max(free, key=lambda a: (dims[a] / counts[a], -a))
        counts[axis] *= p
        left //= p
    return tuple(counts)


def block_bounds(spark: SparkSession, dims: Sequence[int], counts: Sequence[int], share_face: bool = True) -> DataFrame:
    """(gid, real_lo_*, real_hi_*) of a 4-D lattice of blocks, x fastest.  Bounds are inclusive
    node numbers; blocks share their faces or not; the last block takes the remainder."""
    dims, counts = [*dims, *[1] * (4 - len(dims))], [*counts, *[1] * (4 - len(counts))]
    total = counts[0] * counts[1] * counts[2] * counts[3]
    out = spark.range(total).select(F.col("id").cast("int").alias("gid"))
    below = 1
    for p, d, c in zip(_AXES, dims, counts, strict=True):
        size = max(1, (d - 1 if share_face else d) // c)
        index = F.pmod(F.floor(F.col("gid") / F.lit(below)), F.lit(c)).cast("int")
        low = index * size
        high = F.when(index == c - 1, F.lit(d - 1)).otherwise(low + (size if share_face else size - 1))
        out = out.withColumns({f"b{p}": index, f"real_lo_{p}": low, f"real_hi_{p}": high.cast("int")})
        below *= c
    return out


def with_ghosts(blocks: DataFrame, dims: Sequence[int], ghost: Sequence[int] = (1, 1, 1, 1, 1, 1, 0, 1), clamp: bool = False) -> DataFrame:
    """lo_*, hi_*: the real box widened by (before, after) nodes for each axis; a side is widened
    only if the whole ghost layer is inside the domain, or as far as it is with ``clamp``."""
    dims = [*dims, *[1] * (4 - len(dims))]
    out = blocks
    for a, (p, d) in enumerate(zip(_AXES, dims, strict=True)):
        before, after = ghost[2 * a], ghost[2 * a + 1]
        low, high = F.col(f"real_lo_{p}") - before, F.col(f"real_hi_{p}") + after
        if clamp:
            low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(d - 1))
        else:
            low, high = F.when(low >= 0, low).otherwise(F.col(f"real_lo_{p}")), F.when(high <= d - 1, high).otherwise(F.col(f"real_hi_{p}"))
        out = out.withColumns({f"lo_{p}": low, f"hi_{p}": high})
    return out


def bisect(lo: Sequence[int], hi: Sequence[int], levels: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Halve a box ``levels`` times, along x, y, z in turn; halves share no node."""
    boxes = [(tuple(lo), tuple(hi))]
    for level in range(levels):
        a, out = level % 3, []
        for l, h in boxes:
            m = (l[a] + h[a]) // 2
            if m >= h[a]:
                out.append((l, h))
                continue
            out += [(l, tuple(m if b == a else v for b, v in enumerate(h))), (tuple(m + 1 if b == a else v for b, v in enumerate(l)), h)]
        boxes = out
    return boxes


def assign_round_robin(blocks: DataFrame, n_procs: int) -> DataFrame:
    return blocks.withColumn("proc", F.pmod("gid", F.lit(n_procs)))


def assign_contiguous(blocks: DataFrame, n_blocks: int, n_procs: int) -> DataFrame:
    """Runs of equal length; the first ``n_blocks % n_procs`` owners get one more."""
    size, extra = divmod(n_blocks, n_procs)
    cut = extra * (size + 1)
    late = F.lit(extra) + F.floor((F.col("gid") - cut) / F.lit(max(size, 1)))
    return blocks.withColumn("proc", F.when(F.col("gid") < cut, F.floor(F.col("gid") / F.lit(size + 1))).otherwise(late).cast("int"))


def assign_explicit(blocks: DataFrame, owners: DataFrame) -> DataFrame:
    """Owners (gid, proc) as given."""
    return blocks.join(owners, "gid")


def rebalance(blocks: DataFrame, weights: DataFrame, n_procs: int) -> DataFrame:
    """Cut the blocks' order along the lattice into ``n_procs`` runs of about equal weight
    (block, weight); blocks without weight count as 1.  One small sorted table."""
    w = blocks.join(weights.select(F.col("block").alias("gid"), "weight"), "gid", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(1)))
    done = F.sum("weight").over(Window.orderBy("gid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") / 2
    whole = F.sum("weight").over(Window.orderBy("gid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.withColumn("proc", F.least(F.floor(done * n_procs / whole), F.lit(n_procs - 1)).cast("int"))


def rebalance_bisection(blocks: DataFrame, weights: DataFrame, levels: int) -> DataFrame:
    """``2 ** levels`` parts of about equal weight by recursive coordinate bisection: every part is
    cut at its weighted median along its longest side, by the blocks' centres (x, y, z), level by
    level.  Blocks without weight count as 1.  A part's blocks are sorted in one task."""
    centre = {f"c{p}": (F.col(f"real_lo_{p}") + F.col(f"real_hi_{p}")) / F.lit(2.0) for p in "xyz"}
    out = blocks.join(weights.select(F.col("block").alias("gid"), "weight"), "gid", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(1)))
    out = out.withColumns(centre).withColumn("proc", F.lit(0))
    for _ in range(levels):
        part = Window.partitionBy("proc")
        wide = {p: F.max(f"c{p}").over(part) - F.min(f"c{p}").over(part) for p in "xyz"}
        out = out.withColumns({f"w{p}": w for p, w in wide.items()})
        axis = F.when((F.col("wx") >= F.col("wy")) & (F.col("wx") >= F.col("wz")), F.col("cx")).when(F.col("wy") >= F.col("wz"), F.col("cy")).otherwise(F.col("cz"))
        out = out.withColumn("at", axis)
        done = F.sum("weight").over(part.orderBy("at", "gid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") / 2
        half = F.sum("weight").over(part) / 2
        out = out.withColumns({"done": done, "half": half})
        out = out.withColumn("proc", (F.col("proc") * 2 + (F.col("done") > F.col("half")).cast("int"))).drop("done", "half", "at", "wx", "wy", "wz")
    return out.drop("cx", "cy", "cz")


def enqueue(items: DataFrame, neighbours: DataFrame, how: str = "all") -> DataFrame:
    """Items (block, ...) addressed to blocks (``to_block``): to the block that ``target`` names if
    it is a neighbour ("gid"), to the neighbour in direction (dx, dy, dz, dt) ("direction"), to
    every neighbour ("all"), or to the neighbours whose ghost box holds the item's place ("near").

    ``neighbours`` has (gid, neighbour), for "direction" its offset too, for "near" the
    neighbour's box (lo_x.. hi_t); the item's own block counts if the table has it.
    """
    pairs = neighbours.withColumnsRenamed({"gid": "block", "neighbour": "to_block"})
    both = items.join(pairs, "block" if how != "direction" else ["block", "dx", "dy", "dz", "dt"])
    if how == "gid":
        both = both.where(F.col("to_block") == F.col("target"))
    if how == "near":
        for p in _AXES:
            both = both.where(F.col(p).between(F.col(f"lo_{p}"), F.col(f"hi_{p}")))
    return both.select(*items.columns, "to_block")


def lattice_neighbours(blocks: DataFrame, counts: Sequence[int], faces_only: bool = False, periodic: Sequence[bool] = (False,) * 4) -> DataFrame:
    """(gid, neighbour) for the 3^4 offsets (self included), or the faces of x, y, z alone.
    Ids are arithmetic, so there is no join; ``periodic`` axes wrap around."""
    counts = [*counts, *[1] * (4 - len(counts))]
    offsets = []
    for n in range(81):
        o = [n // 3**a % 3 - 1 for a in range(4)]
        if not faces_only or (o[3] == 0 and sum(map(abs, o)) == 1):
            offsets.append(F.struct(*(F.lit(v).alias(p) for p, v in zip(_AXES, o, strict=True))))
    out = blocks.select("gid", *(f"b{p}" for p in _AXES), F.explode(F.array(*offsets)).alias("o"))
    gid, below, ok = F.lit(0), 1, F.lit(True)
    for p, c, wrap in zip(_AXES, counts, [*periodic, *[False] * (4 - len(periodic))], strict=True):
        b = F.col(f"b{p}") + F.col(f"o.{p}")
        b = F.pmod(b, F.lit(c)) if wrap else b
        ok = ok & b.between(0, c - 1)
        gid, below = gid + b * below, below * c
    return out.where(ok).select("gid", gid.cast("int").alias("neighbour")).distinct()


def point_to_block(dims: Sequence[int], counts: Sequence[int], names: Sequence[str] = ("x", "y", "z", "t")) -> Column:
    """The block of a position on a share-face lattice by arithmetic; a shared face belongs to
    the lower block, outside is -1."""
    dims, counts = [*dims, *[1] * (4 - len(dims))], [*counts, *[1] * (4 - len(counts))]
    gid, below, ok = F.lit(0), 1, F.lit(True)
    for n, d, c in zip(names, dims, counts, strict=False):
        size = max(1, (d - 1) // c)
        ok = ok & F.col(n).between(0.0, float(d - 1))
        index = F.greatest(F.lit(0), F.least(F.ceil(F.col(n) / F.lit(float(size))) - 1, F.lit(c - 1)))
        gid, below = gid + index * below, below * c
    return F.when(ok, gid).otherwise(F.lit(-1)).cast("int")


def block_index(blocks: DataFrame, counts: Sequence[int]) -> DataFrame:
    """gid to lattice index and back: ``bx``..``bt`` and ``rank``, which equals gid."""
    counts = [*counts, *[1] * (4 - len(counts))]
    out, rank, below = blocks, F.lit(0), 1
    for p, c in zip(_AXES, counts, strict=True):
        out = out.withColumn(f"b{p}", F.pmod(F.floor(F.col("gid") / F.lit(below)), F.lit(c)).cast("int"))
        rank, below = rank + F.col(f"b{p}") * below, below * c
    return out.withColumn("rank", rank.cast("int"))


def _extents(boxes: DataFrame, low: str, high: str) -> list[float]:
    """The largest extent of the boxes on each axis, at least 1; four numbers come to the driver."""
    row = boxes.agg(*(F.max(F.col(f"{high}_{p}") - F.col(f"{low}_{p}")).cast("double") for p in _AXES)).first()
    return [max(float(v or 1.0), 1.0) for v in row]


def _in_bins(boxes: DataFrame, low: list[Column], high: list[Column], sizes: list[float]) -> DataFrame:
    """``boxes`` once for every bin (__x, __y, __z, __t) of the given sizes that they meet; no box meets more than two a side if none is larger than a bin."""
    for p, a, b, s in zip(_AXES, low, high, sizes, strict=True):
        boxes = boxes.withColumn(f"__{p}", F.explode(F.sequence(F.floor(a / F.lit(s)), F.floor(b / F.lit(s)))))
    return boxes


_BINS = [f"__{p}" for p in _AXES]


def holding(points: DataFrame, boxes: DataFrame, names: Sequence[str] = _AXES, low: str = "real_lo", high: str = "real_hi") -> DataFrame:
    """Every pair of a row of ``points`` (position ``names``) and a box that holds it, bounds included:
    an equi-join on bins as large as the largest box."""
    sizes = _extents(boxes, low, high)
    listed = _in_bins(boxes, [F.col(f"{low}_{p}") for p in _AXES], [F.col(f"{high}_{p}") for p in _AXES], sizes)
    placed = points.withColumns({b: F.floor(F.col(n) / F.lit(s)) for b, n, s in zip(_BINS, names, sizes, strict=True)})
    found = placed.join(listed, _BINS)
    for n, p in zip(names, _AXES, strict=True):
        found = found.where(F.col(n).between(F.col(f"{low}_{p}"), F.col(f"{high}_{p}")))
    return found.drop(*_BINS)


def overlapping(a: DataFrame, b: DataFrame, reach: int = 0) -> DataFrame:
    """Pairs (gid, other) of boxes that overlap on every axis, ``a``'s widened by ``reach``; an equi-join on bins."""
    sizes = [max(x) for x in zip(_extents(a, "real_lo", "real_hi"), _extents(b, "real_lo", "real_hi"), strict=True)]
    ends = [f"real_{s}_{p}" for s in ("lo", "hi") for p in _AXES]
    left = _in_bins(a.select("gid", *ends), [F.col(f"real_lo_{p}") - reach for p in _AXES], [F.col(f"real_hi_{p}") + reach for p in _AXES], sizes)
    right = _in_bins(b.select(F.col("gid").alias("other"), *(F.col(e).alias(f"o_{e}") for e in ends)), [F.col(f"o_real_lo_{p}") for p in _AXES], [F.col(f"o_real_hi_{p}") for p in _AXES], sizes)
    both = left.join(right, _BINS)
    for p in _AXES:
        both = both.where((F.col(f"real_lo_{p}") - reach <= F.col(f"o_real_hi_{p}")) & (F.col(f"real_hi_{p}") + reach >= F.col(f"o_real_lo_{p}")))
    return both.select("gid", "other").distinct()


def time_groups(blocks: DataFrame) -> DataFrame:
    """Distinct time ranges of the blocks, in order: (group, tmin, tmax)."""
    bounds = blocks.select(F.col("real_lo_t").alias("tmin"), F.col("real_hi_t").alias("tmax")).distinct()
    return bounds.withColumn("group", (F.row_number().over(Window.orderBy("tmin", "tmax")) - 1).cast("int"))


def in_time_block(blocks: DataFrame, group: int) -> DataFrame:
    return blocks.join(F.broadcast(time_groups(blocks).where(F.col("group") == group)), (F.col("real_lo_t") == F.col("tmin")) & (F.col("real_hi_t") == F.col("tmax")), "left_semi")


def halo_nodes(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes once for every block whose ghost box holds them: (block, t, i, j, k, u, v, w)."""
    boxes = blocks.select(F.col("gid").alias("block"), *(f"{s}_{p}" for s in ("lo", "hi") for p in _AXES))
    return holding(nodes, boxes, ("i", "j", "k", "t"), "lo", "hi").select("block", *nodes.columns)
