"""Pattern packing by non-negative least squares.

Only the histogram of piece lengths (at most ``limit`` rows) reaches the
driver.  There, all patterns of one, two and three lengths that fill a sequence
exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what is left is packed best fit
decreasing, length by length with multiplicities.  Every piece then looks up
its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise
from .tokens import encoder, tokenizer_path
from .words import slices

#: Patterns that are fitted, those with the longest pieces first.  All of a limit up to 4,800 are fewer (limit ** 2 / 12 + limit / 2);
#: beyond, best fit places the pieces of the others.
PATTERNS = 2_000_000
#: Patterns of a plan, which goes to all tasks: those with the largest counts.
PLAN_PATTERNS = 65_536
#: Pieces of one length that one task ranks.
RANK_ROWS = 1_000_000

Items = tuple[tuple[int, int], ...]


def exact_patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of lengths present that add up to ``limit``; c is 0 in a pair."""
    present = np.zeros(limit + 1, bool)
    present[lengths] = True
    rows, count = [], 0
    for a in lengths[::-1].tolist():
        rest = limit - a
        if rest <= a and rest > 0 and present[rest]:
            rows.append(np.array([[a, rest, 0]]))
            count += 1
        low, high = (rest + 1) // 2, min(a, rest - 1)
        if low <= high:
            b = np.arange(low, high + 1)
            b = b[present[b] & present[rest - b]]
            rows.append(np.stack([np.full(len(b), a), b, rest - b], 1))
            count += len(b)
        if count >= PATTERNS:
            break
    return np.concatenate([np.zeros((0, 3), np.int64), *rows])


def fit_counts(patterns: np.ndarray, hist: np.ndarray, rounds: int = 60) -> np.ndarray:
    """min ||A x - hist|| over x >= 0, A the patterns' length counts, by accelerated projected gradient."""
    size = len(hist)
    a, b, c = patterns.T
    two = hist.copy()
    two[0] = 0  # the third place of a pair

    def ahead(x: np.ndarray) -> np.ndarray:
        out = np.bincount(a, x, size) + np.bincount(b, x, size) + np.bincount(c, x, size)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[a] + r[b] + r[c]

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(ahead(v / np.linalg.norm(v)))
    step = 0.9 / np.linalg.norm(v)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0.0, y - step * back(ahead(y) - two))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / u * (z - x), z, u
    return x


def best_fit(hist: np.ndarray, limit: int) -> list[tuple[Items, int]]:
    """Best fit decreasing over a histogram: (items, repeats), an item being (length, times)."""
    left = hist.astype(np.int64)
    open_: dict[int, list[list]] = {}  # room left -> [items, repeats]
    rooms: list[int] = []
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                items, repeats = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, items, repeats = limit, (), n
            times = min(room // length, n)
            take = min(repeats, n // times)
            if items and take < repeats:
                if room not in open_:
                    open_[room] = []
                    rooms.insert(bisect_left(rooms, room), room)
                open_[room].append([items, repeats - take])
            n -= take * times
            room -= times * length
            if room not in open_:
                open_[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_[room].append([(*items, (length, times)), take])
    return [(items, repeats) for group in open_.values() for items, repeats in group]


def plan(hist: np.ndarray, limit: int) -> list[tuple[Items, int]]:
    """Patterns and how often each is used; together they use ``hist[l]`` pieces of each length l."""
    rest = hist.astype(np.int64).copy()
    done: list[tuple[Items, int]] = []
    if rest[limit]:
        done.append((((limit, 1),), int(rest[limit])))
        rest[limit] = 0
    patterns = exact_patterns(np.flatnonzero(rest), limit)
    x = fit_counts(patterns, rest.astype(float)) if len(patterns) else np.zeros(0)
    if len(x) > PLAN_PATTERNS:  # fitted once more among those of most use
        patterns = patterns[np.sort(np.argpartition(-x, PLAN_PATTERNS)[:PLAN_PATTERNS])]
        x = fit_counts(patterns, rest.astype(float))
    left = rest.tolist()
    order = np.argsort(-x, kind="stable")
    order = order[x[order] >= 0.5]
    for pattern, n in zip(patterns[order].tolist(), np.rint(x[order]).astype(np.int64).tolist(), strict=True):
        items = tuple((v, pattern.count(v)) for v in dict.fromkeys(pattern) if v)
        n = min(n, *(left[v] // m for v, m in items))
        if n:
            done.append((items, n))
            for v, m in items:
                left[v] -= n * m
    return done + best_fit(np.array(left), limit)


def _places(used: list[tuple[Items, int]]) -> dict[str, np.ndarray]:
    """For each pattern item the ranks it takes of its length and where they go, sorted by (length, rank)."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for items, repeats in used:
        offset = 0
        for length, times in items:
            lo = rank.get(length, 0)
            rows.append((length, lo, base, times, offset))
            rank[length] = lo + repeats * times
            offset += length * times
        base += repeats
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), a.T, strict=True))


def _pieces(df: DataFrame, limit: int, path: str, end_id: int, with_ids: bool) -> DataFrame:
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "salt"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = enc.encode(part.column("text"), end_id)
                size = np.diff(offsets)
                n = -(-size // limit)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * limit
                length = np.minimum(size[row] - start, limit)
                raw, at = memoryview(np.ascontiguousarray(ids)).cast("B"), (offsets[row] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(row)), pa.int32())], names=names)

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", salt int")


def pack_documents(df: DataFrame, limit: int = 4096, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack every text of ``df`` (null: empty) into sequences of at most ``limit`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with ``with_ids`` the ids.  Every row of the input gives at
    least one piece, repeated rows too; a null doc_id stays null; other columns
    of the input are ignored.  An empty table gives no row.

    A length that many pieces share is ranked in parts of about ``RANK_ROWS``
    pieces (by a hash of the row and its place in its batch, so that rows
    repeated whole spread too): no task gets all pieces of one length.
    """
    spark = df.sparkSession
    pieces = materialise(_pieces(df, limit, tokenizer or tokenizer_path(), end_id, with_ids), "pieces")
    hist = np.zeros(limit + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``limit`` rows
        hist[r["length"]] = r["count"]
    found = np.flatnonzero(hist)
    places = _places(plan(hist, limit))
    parts = spark.createDataFrame([(int(v), int(-(-hist[v] // RANK_ROWS))) for v in found], "length long, parts long")
    keyed = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), "parts"))
    sizes = keyed.groupBy("length", "part").count()  # at most limit + pieces / RANK_ROWS rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = keyed.join(F.broadcast(sizes), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(own) - 1).select(*(c for c in pieces.columns if c != "salt"), "rank")

    columns = [c for c in pieces.columns if c != "salt"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (places["length"] << 48) | places["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            nth = rank - places["rank"][k]
            times = places["times"][k]
            sequence = places["sequence"][k] + nth // times
            offset = places["offset"][k] + nth % times * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = pieces.drop("salt").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(place, schema)
