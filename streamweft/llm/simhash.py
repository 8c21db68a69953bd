"""SimHash near-dedup by random bit sampling.

A document's signature has ``BITS`` bits, the signs of the sums of its distinct
five-word shingles' hash bits.  Two documents are linked when the similarity
(Jaccard) of their shingle sets is 0.8 or more; a class is a connected component
of links.  The distance of two signatures estimates the similarity, with a known
spread: a distance ``SPREAD`` standard deviations below that of 0.8 is a link,
one as far above it is none, and pairs between the two are decided on the
shingle sets themselves.

The number of tables follows from the sampled bits, so that the share of pairs of
similarity 0.8 that are lost stays under ``MISS`` at every size (``table_plan``).
Each table samples its own coordinates, which name a signature's bucket.
All pairs of a bucket are compared, but for pairs known to be of one class: a
bucket of up to ``CAP`` rows whole; a larger one in random blocks first, and
then, when the links so far have made classes, all members outside its most
frequent class with all its members, block by block.
Within a block sure links are a spanning forest, so neither pairs nor edges grow
as the square of a group of copies; doubtful pairs of one class are never verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialise
from .words import Words, mix64, slices, split_words

SHINGLE = 5
SIMILARITY = 0.8
BITS = 512
#: Half the width of the doubtful distances, in standard deviations of the distance at the similarity asked for.
SPREAD = 2.4
#: At most this share of the pairs of just that similarity is lost, whatever the size of the table.
MISS = 0.04
#: Texts in a bucket, on average, at most.
MEAN = 512
#: Rows of a block; a bucket of more is compared block by block.
CAP = 2048
#: A word sequence of more than 1 / HOT of all rows is joined by broadcast.
HOT = 2000
#: Up to so many texts' keys (24 bytes each) are broadcast to fetch texts to verify; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bits kept of a shingle's hash; the others number the texts of a slice.
_KEEP = 48
_ROWS, _PIVOTS, _PART = 32, 32, 256


def distance_limits(similarity: float, bits: int = BITS, spread: float = SPREAD) -> tuple[int, int]:
    """Differing bits up to which two sets are surely of Jaccard ``similarity`` (for sets of equal size), and beyond which they surely aren't."""
    share = _share_of(similarity)
    room = spread * math.sqrt(bits * share * (1 - share))
    return max(0, math.floor(bits * share - room)), min(bits, math.ceil(bits * share + room))


def _share_of(similarity: float) -> float:
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def lost_share(sampled: int, tables: int, similarity: float, bits: int = BITS, spread: float = SPREAD) -> float:
    """The share of pairs of Jaccard ``similarity`` that meet in no table or are beyond the distance limit; distances are binomial."""
    share, high = _share_of(similarity), distance_limits(similarity, bits, spread)[1]
    found = 0.0
    for d in range(high + 1):
        meet = math.comb(bits - d, sampled) / math.comb(bits, sampled)
        found += math.comb(bits, d) * share**d * (1 - share) ** (bits - d) * (1 - (1 - meet) ** tables)
    return 1 - found


def table_plan(texts: int, similarity: float, bits: int = BITS, miss: float = MISS, spread: float = SPREAD) -> tuple[int, int]:
    """Sampled bits for ``texts`` texts, and the number of tables that loses at most ``miss`` of the pairs of just that similarity."""
    sampled = max(8, math.ceil(math.log2(max(2, texts) / MEAN)))
    low, high = 1, 1
    while lost_share(sampled, high, similarity, bits, spread) > miss and high < 1 << 16:
        low, high = high, 2 * high
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if lost_share(sampled, middle, similarity, bits, spread) > miss else (low, middle)
    return sampled, high


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (``_KEEP`` bits) by document, and the n+1 offsets; a document of fewer
    than ``size`` words has one shingle, one without words none."""
    h = words.hashes()
    ok = words.inside(size)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < size))
    value, owner = words.ngrams(size, h)[ok], words.doc[ok]
    if len(short):
        extra = []
        for d in short.tolist():
            x = n[d : d + 1].astype(np.uint64)
            for v in h[words.first[d] : words.first[d + 1]]:
                x = mix64(x * np.uint64(3) + v)
            extra.append(x)
        value, owner = np.concatenate([value, *extra]), np.append(owner, short)
    key = (owner.astype(np.uint64) << np.uint64(_KEEP)) | (value >> np.uint64(64 - _KEEP))
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    at = np.searchsorted(key, np.arange(len(n), dtype=np.uint64) << np.uint64(_KEEP))
    return key & np.uint64((1 << _KEEP) - 1), np.append(at, len(key))


def _lanes(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Hash bits of shingles: a 64-bit word a multiplier."""
    x = values[..., None] * multipliers
    x ^= x >> np.uint64(32)
    return x


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry bits of three words."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _bit_counts(values: np.ndarray, start: np.ndarray, size: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """How many of ``values[start:start + size]`` have each hash bit.  Sizes fall and are ``_PART`` at most.
    Counters are bit-sliced: plane k holds bit k of all counters, eight values at once go through carry-save adders."""
    planes = np.zeros((_PART.bit_length(), len(start), len(multipliers)), np.uint64)
    eight = np.arange(8)[:, None]
    for j in range(0, int(size[0]), 8):
        alive = int(np.searchsorted(-size, -j, "left"))
        x = _lanes(values[start[:alive] + j + eight], multipliers)
        whole = int(np.searchsorted(-size, -(j + 8), "right"))
        if whole < alive:
            x[:, whole:] *= (eight + j < size[whole:alive])[:, :, None]
        p = planes[:, :alive]
        one, a = _add(p[0], x[0], x[1])
        one, b = _add(one, x[2], x[3])
        two, c = _add(p[1], a, b)
        one, a = _add(one, x[4], x[5])
        p[0], b = _add(one, x[6], x[7])
        p[1], d = _add(two, a, b)
        p[2], carry = _add(p[2], c, d)
        for k in range(3, len(planes)):
            p[k], carry = p[k] ^ carry, p[k] & carry
    total = np.zeros((len(start), 64 * len(multipliers)), np.int32)
    for k, plane in enumerate(planes):
        total += np.unpackbits(plane.view(np.uint8), axis=1).astype(np.int32) << k
    return total


def signatures(values: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Packed signatures, (documents, bits / 8) bytes.  A bit whose sum is zero is that of the smallest shingle."""
    n, size = len(offsets) - 1, np.diff(offsets)
    multipliers = mix64(np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    mixed = mix64(np.concatenate([values, np.zeros(8, np.uint64)]))
    parts = -(-size // _PART)  # long documents count part by part
    owner = np.repeat(np.arange(n), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start, length = offsets[owner] + nth * _PART, np.minimum(size[owner] - nth * _PART, _PART)
    order = np.argsort(-length, kind="stable")
    twice = np.zeros((n, bits), np.int32)
    for k in range(0, len(order), 512):
        some = order[k : k + 512]
        np.add.at(twice, owner[some], 2 * _bit_counts(mixed, start[some], length[some], multipliers))
    bit = twice > size[:, None]
    tie = np.flatnonzero(((twice == size[:, None]) & (size > 0)[:, None]).any(1))
    if len(tie):
        low = np.unpackbits(_lanes(mixed[offsets[tie]], multipliers).view(np.uint8), axis=1) > 0
        bit[tie] = np.where(twice[tie] == size[tie, None], low, bit[tie])
    return np.packbits(bit, axis=1)


def signature_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, tie, words, signature): ``tie`` is a hash of the text, ``words`` a 128-bit digest of its word sequence."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = split_words(part.column("text"))
                sig = signatures(*shingle_hashes(w), bits)
                digest = np.zeros((len(w.first) - 1, 2), np.uint64)
                some = np.flatnonzero(np.diff(w.first))
                nth = np.arange(len(w)) - np.repeat(w.first[:-1], np.diff(w.first))
                for k in (0, 1):
                    mixed = mix64(w.hashes(k) + mix64(nth.astype(np.uint64) + np.uint64(k + 1)))
                    if len(some):
                        digest[some, k] = np.add.reduceat(mixed, w.first[some])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), pa.array([x.tobytes() for x in digest], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "tie", "words", "signature"],
                )

    return rows.mapInArrow(sign, "doc_id long, tie long, words binary, signature binary")


def _orders(tables: int, bits: int, sampled: int) -> np.ndarray:
    rng = np.random.default_rng(20240601)
    return np.stack([rng.permutation(bits)[:sampled] for _ in range(tables)])


def _buckets(signature: pa.Array, orders: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of packed signatures, a table at a time."""
    place = np.int64(1) << np.arange(orders.shape[1] - 1, -1, -1, dtype=np.int64)
    sig = np.frombuffer(b"".join(signature.to_pylist()), np.uint8).reshape(len(signature), -1)
    ones = np.unpackbits(sig, axis=1)
    for order in orders:
        yield ones[:, order] @ place


def _keyed(signed: DataFrame, tables: int, bits: int, sampled: int) -> DataFrame:
    """Every signature once a table: (table, bucket, id, signature)."""
    orders = _orders(tables, bits, sampled)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for t, bucket in enumerate(_buckets(batch.column("signature"), orders)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bucket), t, np.int16)), pa.array(bucket), batch.column("id"), batch.column("signature")],
                    names=["table", "bucket", "id", "signature"],
                )

    return signed.select("id", "signature").mapInArrow(spread, "table short, bucket long, id long, signature binary")


def _large(signed: DataFrame, tables: int, bits: int, sampled: int, cap: int) -> DataFrame:
    """(table, bucket, n) of the buckets of more than ``cap`` signatures, counted by batch first."""
    orders = _orders(tables, bits, sampled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for t, bucket in enumerate(_buckets(batch.column("signature"), orders)):
                value, n = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), t, np.int16)), pa.array(value), pa.array(n)], names=["table", "bucket", "n"])

    counted = signed.select("signature").mapInArrow(count, "table short, bucket long, n long")
    return counted.groupBy("table", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > cap)


def _near(a: np.ndarray, columns: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (i, j) and distances of the pairs of rows ``a`` (n, words) and ``columns`` (words, m) that
    differ in at most ``limit`` bits.  A pair that is beyond it in the first words already isn't read further."""
    some = next((k for k in range(1, len(columns)) if 32 * k - 12 * math.sqrt(k) > limit), len(columns))
    part = np.bitwise_count(a[:, 0, None] ^ columns[0]).astype(np.uint8 if some < 4 else np.uint16)
    for k in range(1, some):
        part += np.bitwise_count(a[:, k, None] ^ columns[k])
    i, j = np.nonzero(part <= limit)
    full = part[i, j] + np.bitwise_count(a[i, some:] ^ columns[some:, j].T).sum(1, dtype=np.int32)
    use = full <= limit
    return i[use], j[use], full[use]


def link_group(ids: np.ndarray, sig: np.ndarray, limit: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links within a group, and the position of one member of each class.
    A member is compared with members that have no class yet only."""
    links, heads = [], []
    rest, columns = np.arange(len(ids)), np.ascontiguousarray(sig.T)
    free = np.ones(len(ids), bool)
    while len(rest):
        batch = rest[:_ROWS]
        i, j, _ = _near(sig[batch], columns, limit)
        j = rest[j]
        ends = np.searchsorted(i, np.arange(len(batch) + 1))
        for k, head in enumerate(batch.tolist()):
            if not free[head]:
                continue
            heads.append(head)
            free[head] = False
            found = j[ends[k] : ends[k + 1]]
            found = found[free[found]]
            free[found] = False
            links += [(int(ids[head]), y) for y in ids[found].tolist()]
            queue = found.tolist()
            while queue:
                some, queue = queue[:_ROWS], queue[_ROWS:]
                stay = free[rest]
                rest, columns = rest[stay], columns[:, stay]
                if not len(rest):
                    break
                x, y, _ = _near(sig[some], columns, limit)
                y, first = np.unique(y, return_index=True)  # one link is enough
                found = rest[y]
                free[found] = False
                links += zip(ids[np.array(some)[x[first]]].tolist(), ids[found].tolist(), strict=True)
                queue += found.tolist()
        stay = free[rest]
        rest, columns = rest[stay], columns[:, stay]
    return links, np.array(heads, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows of equal ``by``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy() for c in by], 1)
        cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
            if held and (names[i] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = names[i]
    if held:
        yield pa.Table.from_batches(held)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _pairs(sure: list[tuple[int, int]], doubtful: list[np.ndarray]) -> pa.RecordBatch:
    a = np.concatenate([np.array(sure, np.int64).reshape(-1, 2), *doubtful])
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(np.arange(len(a)) < len(sure))], names=["a", "b", "sure"])


def _doubtful(ids: np.ndarray, sig: np.ndarray, links: list[tuple[int, int]], heads: np.ndarray, low: int, high: int) -> list[np.ndarray]:
    """Pairs of different classes of a group at distances above ``low`` and up to ``high``.  ``links`` name each found member after a member found before."""
    class_ = {int(ids[h]): k for k, h in enumerate(heads.tolist())}
    for x, y in links:
        class_[y] = class_[x]
    own = np.array([class_[x] for x in ids.tolist()])
    most = np.bincount(own).argmax()
    order = np.argsort(own == most, kind="stable")  # the most frequent class last: never compared with itself
    ids, sig, own = ids[order], sig[order], own[order]
    columns, out = np.ascontiguousarray(sig.T), []
    for k in range(0, int((own != most).sum()), _ROWS):
        x, y, far = _near(sig[k : k + _ROWS], columns[:, k:], high)
        x, y = x + k, y + k
        use = (x < y) & (own[x] != own[y]) & (far > low)
        out.append(np.stack([np.minimum(ids[x[use]], ids[y[use]]), np.maximum(ids[x[use]], ids[y[use]])], 1))
    return out


def _block_links(keyed: DataFrame, large: DataFrame | None, low: int, high: int, cap: int) -> DataFrame:
    """(a, b, sure) within buckets, and the sure ones within the random blocks of about ``cap`` rows of ``large`` ones.
    Every block has the ``_PIVOTS`` of its bucket too, so that a large class mostly holds together."""
    by = ["table", "bucket", "block"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, by):
            if len(group) > 1:
                ids, sig = group["id"].to_numpy(), _signatures(group["signature"])
                links, heads = link_group(ids, sig, low)
                yield _pairs(links, [] if group["block"][0].as_py() >= 0 else _doubtful(ids, sig, links, heads, low, high))

    rows = keyed.withColumn("block", F.lit(-1))
    if large is not None:
        blocks = F.ceil(F.col("n") / cap).cast("int")
        own = F.pmod(F.xxhash64("id", "table"), blocks).cast("int")
        every = F.pmod(F.xxhash64("id", F.lit(1)), F.col("n")) < _PIVOTS
        block = F.when(F.col("n").isNull(), F.array(F.lit(-1))).when(every, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
        rows = keyed.join(F.broadcast(large), ["table", "bucket"], "left")
        rows = rows.select("table", "bucket", "id", "signature", F.explode(block).alias("block"))
    return rows.repartition(*by).sortWithinPartitions(*by, "id").mapInArrow(link, "a long, b long, sure boolean").distinct()


def _cross_links(keyed: DataFrame, large: DataFrame, classes: DataFrame, low: int, high: int, cap: int) -> DataFrame:
    """(a, b, sure) between different classes within large buckets, exhaustively.

    Of two members of different classes one at least is outside the bucket's most
    frequent class.  So the members outside it are compared with all, in blocks
    of about ``cap`` by ``cap`` rows that go to any task.
    """
    by = ["table", "bucket", "i", "j"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, by):
            ids, class_, sig, few = group["id"].to_numpy(), group["class"].to_numpy(), _signatures(group["signature"]), group["few"].to_numpy()
            a, b = np.flatnonzero(few), np.flatnonzero(~few)
            columns, sure, rest = np.ascontiguousarray(sig[b].T), set(), []
            for k in range(0, len(a) if len(b) else 0, _ROWS):
                x, y, far = _near(sig[a[k : k + _ROWS]], columns, high)
                x, y = a[x + k], b[y]
                other = class_[x] != class_[y]
                x, y, far = x[other], y[other], far[other]
                sure.update(zip(class_[x[far <= low]].tolist(), class_[y[far <= low]].tolist(), strict=True))
                x, y = ids[x[far > low]], ids[y[far > low]]
                rest.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            if sure or rest:
                yield _pairs(list(sure), rest)

    rows = keyed.join(F.broadcast(large), ["table", "bucket"]).join(classes.withColumnRenamed("node", "id"), "id", "left")
    rows = rows.select("table", "bucket", "n", "id", "signature", F.coalesce("component", "id").alias("class"))
    rows = materialise(rows, "large-buckets")
    most = rows.groupBy("table", "bucket", "n", "class").count().groupBy("table", "bucket", "n")
    most = most.agg(F.max_by("class", F.struct("count", "class")).alias("most"), F.max("count").alias("count"))
    most = most.where("n > count").select("table", "bucket", "most", F.ceil((F.col("n") - F.col("count")) / cap).cast("int").alias("few_blocks"))
    rows = rows.join(F.broadcast(most), ["table", "bucket"])
    number = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    blocks = F.ceil(F.col("n") / cap).cast("int")
    columns = ["table", "bucket", "id", "class", "signature"]
    every = rows.select(*columns, F.lit(False).alias("few"), number(2, blocks).alias("i"), F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("j"))
    few = rows.where("class != most").select(*columns, F.lit(True).alias("few"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), number(3, F.col("few_blocks")).alias("j"))
    return every.unionByName(few).repartition(*by).sortWithinPartitions(*by).mapInArrow(link, "a long, b long, sure boolean").distinct()


def _of_other_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their classes x and y, of those that differ."""
    for at, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(classes.select(F.col("node").alias(at), F.col("component").alias(name)), at, "left").withColumn(name, F.coalesce(name, at))
    return pairs.where("x != y")


def _linked(texts: DataFrame, sampled: int, tables: int, bits: int, low: int, high: int, cap: int, similar) -> DataFrame:
    """(node, component) of the (id, signature) that share a bucket with a near one.  ``similar`` gives the pairs (a, b) of its argument that are links."""
    large = materialise(_large(texts, tables, bits, sampled, cap), "large")
    some = not large.isEmpty()
    keyed = _keyed(texts, tables, bits, sampled)
    pairs = materialise(_block_links(keyed, large if some else None, low, high, cap), "pairs")
    classes = connected_components(pairs.where("sure"))
    if some:
        cross = materialise(_cross_links(keyed, large, materialise(classes, "classes"), low, high, cap), "cross-pairs")
        pairs = pairs.unionByName(cross)
        classes = connected_components(pairs.where("sure"))
    classes = materialise(classes, "classes")
    doubtful = materialise(_of_other_classes(pairs.where("NOT sure").select("a", "b").distinct(), classes), "doubtful-pairs")
    if doubtful.isEmpty():
        return classes
    joined = connected_components(doubtful.join(similar(doubtful.select("a", "b")), ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = classes.select("node", "component").unionByName(joined.select("node", F.col("node").alias("component")).join(classes.select("node"), "node", "left_anti"))
    return named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def _verified(df: DataFrame, texts: DataFrame, pairs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts' shingle sets have that Jaccard similarity or more, decided on the sets.
    ``texts`` says which row of ``df`` has the text of an id."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(texts.select("id", "row"), "id")
    needed = materialise(needed.select("id", F.col("row.doc_id").alias("doc_id"), F.col("row.tie").alias("tie")), "texts-to-verify")
    rows = df.select(F.col(doc_id).cast("long").alias("own"), F.xxhash64(text).alias("own_tie"), F.col(text).alias("text"))
    match = F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_tie") == F.col("tie"))
    rows = rows.join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, match).select("id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, at = shingle_hashes(split_words(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))], names=["id", "shingles"])

    sets = materialise(rows.mapInArrow(cut, "id long, shingles array<long>").dropDuplicates(["id"]), "shingle-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b")
    common: Column = F.size(F.array_intersect("s", "t"))
    return both.where(common >= F.lit(float(similarity)) * (F.size("s") + F.size("t") - common)).select("a", "b")


def _classes(df: DataFrame, doc_id: str, text: str, similarity: float, bits: int, tables: int | None, cap: int) -> DataFrame:
    """(doc_id, tie, component, class_id) of every row."""
    signed = materialise(signature_table(df, doc_id, text, bits), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    texts = signed.groupBy("words").agg(F.min("doc_id").alias("first"), F.min("signature").alias("signature"), F.min(row).alias("row"))
    # a text is named by its smallest document id, or by its own hash where it has none or shares it with another text
    shared = texts.where("first IS NOT NULL").groupBy("first").count().where("count > 1").select("first", F.lit(True).alias("shared"))
    own = F.when(F.col("shared") | F.col("first").isNull(), F.xxhash64("words")).otherwise(F.col("first"))
    texts = materialise(texts.join(shared, "first", "left").select("words", "first", "signature", "row", own.alias("id")), "signed-texts")
    low, high = distance_limits(similarity, bits)
    sampled, enough = table_plan(texts.count(), similarity, bits)
    classes = _linked(texts, sampled, tables or enough, bits, low, high, cap, lambda pairs: _verified(df, texts, pairs, doc_id, text, similarity))
    named = texts.join(classes, F.col("id") == F.col("node"), "left").select("words", "first", F.coalesce("component", "id").alias("component"))
    best = named.groupBy("component").agg(F.min("first").alias("class_id"))
    named = materialise(named.join(best, "component").select("words", "component", "class_id"), "classes")
    # copies of one word sequence may be a third of all rows: the frequent ones, fewer than HOT, are broadcast
    often = signed.groupBy("words").count().where(F.col("count") * HOT > signed.count()).select("words")
    hot = materialise(named.join(often, "words", "left_semi").withColumn("hot", F.lit(True)), "frequent")
    marked = signed.select("doc_id", "tie", "words").join(F.broadcast(hot), "words", "left")
    rest = marked.where("hot IS NULL").select("doc_id", "tie", "words").join(named, "words")
    columns = ["doc_id", "tie", "component", "class_id"]
    return marked.where("hot").select(*columns).unionByName(rest.select(*columns))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bits: int = BITS, tables: int | None = None, cap: int = CAP
) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id (the smallest doc_id of its class), kept.

    Word sequences are compared as they are.  Texts of the same words are one
    class whatever their white space; so are all texts without words, null
    included.  A text of one to four words has one shingle.  Rows that share an
    id are classed each by its text.  ``kept`` says that the row has its class's
    id; rows without an id have it only in classes without one, where class_id
    is null.  Other columns are ignored; an empty table gives no row.
    """
    rows = _classes(df, doc_id, text, similarity, bits, tables, cap)
    return rows.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def near_dedup(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bits: int = BITS, tables: int | None = None, cap: int = CAP
) -> DataFrame:
    """The rows of ``df`` that stay, one of each class, with all their columns: the smallest
    doc_id, and of several rows with that id the one whose text comes first in hash order."""
    rows = _classes(df, doc_id, text, similarity, bits, tables, cap).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = rows.groupBy("component").agg(F.first("doc_id").alias("__id"), F.min("tie").alias("__tie"), F.count("*").alias("__n"))
    stay = materialise(stay.select("__id", "__tie", "__n"), "near-kept")
    match = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__row_tie") == F.col("__tie"))
    kept = df.withColumn("__row_tie", F.xxhash64(text)).join(stay, match, "left_semi")
    if not stay.where("__n > 1").isEmpty():  # rows of one id: some may be repeated whole
        kept = kept.dropDuplicates([doc_id, "__row_tie"])
    return kept.drop("__row_tie")
