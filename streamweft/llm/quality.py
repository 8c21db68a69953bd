"""Quality classifier: gradient-boosted trees over document statistics.

Statistics are counted on the UTF-8 bytes and word hashes of a batch by numpy.
The trees are trained on the driver from at most ``TRAIN_ROWS`` labelled
documents; scoring is one pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gbt import Forest, fit
from .words import Words, slices, split_words

#: Labelled documents to learn from: those of smallest id hash, if there are more.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_SIGNS = "#*|$%&!?.,:;-_=<>{}[]()/\\@\"'+~^"


def _run_lengths(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values (their upper 48 bits) by document: the document of each distinct one, and how often it occurs there."""
    key = (owner.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16))
    key.sort()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (key[at] >> np.uint64(48)).astype(np.int64), np.diff(np.append(at, len(key)))


def document_statistics(texts: pa.Array, words: Words | None = None, hashes: np.ndarray | None = None) -> np.ndarray:
    """One row of finite statistics a text (a slice's, so 16 bits name one); null and empty texts have the same row."""
    w = words if words is not None else split_words(texts)
    data, offsets, n = w.data, w.offsets, len(w.first) - 1

    def per_words(values: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(values, dtype=np.float64))
        return total[w.first[1:]] - total[w.first[:-1]]

    size = np.diff(offsets).astype(float)
    words_ = np.diff(w.first).astype(float)
    length = (w.ends - w.starts).astype(float)
    byte, word = np.maximum(size, 1), np.maximum(words_, 1)
    kinds = np.zeros(256, np.uint8)
    for k, group in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), (10,)), 1):
        kinds[list(group)] = k
    kind = kinds[data]
    of_kind = np.bincount(np.repeat(np.arange(n) * 8, np.diff(offsets)) + kind, minlength=8 * n).reshape(-1, 8).astype(float)
    upper, lower, digit, wide, feeds = of_kind[:, 1:6].T
    lines = feeds + 1
    out = [np.log1p(size), np.log1p(words_), per_words(length) / word, per_words(length**2) / word, upper / byte, lower / byte, digit / byte, wide / byte, np.log1p(feeds), words_ / lines]
    sign = np.zeros(256, np.uint8)
    for k, c in enumerate(_SIGNS, 1):
        sign[ord(c)] = k
    counts = np.zeros((len(_SIGNS) + 1, n))
    at = np.flatnonzero(sign[data])
    if len(at):
        owner = np.searchsorted(offsets, at, "right") - 1
        counts = np.bincount(sign[data[at]].astype(np.int64) * n + owner, minlength=(len(_SIGNS) + 1) * n).reshape(-1, n).astype(float)
    out += [c / byte for c in counts[1:]] + [counts[1:].sum(0) / byte, words_ / (counts[1 + _SIGNS.index(".")] + 1)]
    if len(w):
        last, head = sign[data[w.ends - 1]] > 0, kind[w.starts]
        capital = head == 1
        twice = np.append(False, (w.ends[1:] - w.starts[1:] == w.ends[:-1] - w.starts[:-1]))
        h = hashes if hashes is not None else w.hashes()
        twice &= np.append(False, h[1:] == h[:-1])
        owner = w.doc
        of, runs = _run_lengths(owner, h)
        distinct, top = np.bincount(of, minlength=n).astype(float), np.zeros(n)
        some = np.flatnonzero(words_)
        top[some] = np.maximum.reduceat(runs, np.searchsorted(of, some))
        ok = w.inside(4)
        of, runs = _run_lengths(owner[ok], w.ngrams(4, h)[ok])
        repeats = np.bincount(of, runs - 1, minlength=n)
        out += [per_words(last) / word, per_words(capital) / word, per_words(length > 12) / word, per_words(length < 3) / word, per_words(twice) / word, distinct / word, top / word, repeats / word]
    else:
        out += [np.zeros(n)] * 8
    return np.stack(out, 1)


def fold_of(doc_id: str) -> Column:
    """crc32 of the id's decimal text, modulo ``FOLDS``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def _statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    schema = rows.select(*columns).withColumn("x", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = document_statistics(part.column("text"))
                at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=[*columns, "x"])

    return rows.select(*columns, "text").mapInArrow(run, schema)


def labelled_sample(labels: DataFrame, label: str, rows: int, folds: bool = True) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled ids, one row an id (its largest label), in
    the training folds; rows without id or label don't count.  Bounded, so it may be broadcast."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    good = good.where(fold_of("doc_id") != HELD_OUT) if folds else good
    one = good.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train_quality(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Learn from the labelled documents outside the held-out fold.  Only the text's
    statistics are inputs.  An id that repeats in ``df`` gives one row, with its smallest text."""
    sample = labelled_sample(labels, label, rows)
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = _statistics(texts, ["doc_id", "label"]).collect()
    found.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in found], float)
    y = np.array([r.label for r in found], float)
    return fit(x if len(x) else np.zeros((0, 1)), y)


def score_quality(df: DataFrame, forest: Forest, columns: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """``columns`` of every row, as they are, and ``score`` (none of them)."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)), F.col(f"`{text}`").alias("text"))
    schema = rows.drop("text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = forest.score(document_statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found)], names=[*names, "score"])

    return rows.mapInArrow(run, schema).toDF(*columns, score)


def classify_quality(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted.

    Null and empty texts score alike.  Equal texts get equal scores.  A null
    doc_id is not held out.  Without labels every score is 0.5.  Other columns
    are ignored; an empty table gives no row.
    """
    forest = train_quality(df, labels, doc_id, text)
    scored = score_quality(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), forest, ["doc_id"])
    return scored.select("doc_id", (fold_of("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, with all their columns as they are, that the classifier accepts.

    Null and empty texts are judged alike, as are equal texts and rows repeated
    whole, so all or none of them stay.  Without labels every score is 0.5 and,
    with the threshold above it, no row stays.  An empty table gives no row.
    """
    forest = train_quality(df, labels, doc_id, text)
    name = "score"
    while name in df.columns:
        name += "_"
    return score_quality(df, forest, df.columns, text, name).where(F.col(name) >= threshold).drop(name)
