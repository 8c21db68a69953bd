"""Repeated passages by De Bruijn compaction.

The k-mers, windows of ``WINDOW`` words, are the edges of a De Bruijn graph whose
nodes are their first and last k - 1 words.

1. Windows that can repeat: a window's anchor is the ``ANCHOR``-word gram of
   smallest hash in it, and equal windows have equal anchors.  One row an
   anchor (about an eighth of the words) is grouped by its hash; windows whose
   anchor is unique in the corpus are left out of the graph.
2. The others become edges, one row for each distinct window of a map batch;
   all later ones of the batch are settled there as repeats.  Edges that
   several batches have stay, with all these occurrences.
3. An edge leads to the next one of its document.  Where all occurrences of an
   edge have one successor, and all of that one have the first as predecessor,
   the node between does not branch.  A Spark join of the edges with their
   successors finds these nodes, and nonbranching paths are compacted to
   their first edge along a document that has them.
4. A path's occurrences are read again at their source coordinates: only spans
   with the same words (128-bit digests) are repeats; all but the first
   (document id, then start) go.

A passage that a third of all documents share costs each reducer one row a
batch, not one a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise
from .words import Words, slices, split_words

WINDOW = 20
ANCHOR = 6

_SINGLE, _WITNESS, _SETTLED = 0, 1, 2
_LAST_ID = (1 << 63) - 1
_EDGE = "edge long, next long, id long, tie long, start int, n int"


def anchors(words: Words, hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each word the position of the smallest gram (leftmost of equal ones) in the
    window from it on; -1 where no window starts."""
    width, g = window - gram + 1, words.ngrams(gram, hashes)
    n = len(g)
    at = np.full(n, -1, np.int64)
    if n < window:
        return at
    value, pos, reach = g, np.arange(n), 1
    while reach < width:
        step = min(reach, width - reach)
        v, p = value[:-step] if step else value, pos[:-step]
        better = value[step:] < v
        value, pos = np.where(better, value[step:], v), np.where(better, pos[step:], p)
        reach += step
    ok = words.inside(window)
    m = min(n, len(pos))
    at[:m] = np.where(ok[:m], pos[:m], -1)
    return at


def _repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value occurs again in the array, and whether it is its first occurrence."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = v[1:] == v[:-1]
    again, first = np.zeros(len(v), bool), np.ones(len(v), bool)
    again[1:] |= same
    again[:-1] |= same
    first[1:] = ~same
    out_again, out_first = np.empty_like(again), np.empty_like(first)
    out_again[order], out_first[order] = again, first
    return out_again, out_first


def _texts(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, the order key (id, tie) and text of every row, and of one row a key.  tie is 0 unless ids repeat in the table."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    unique = rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    tie = F.lit(0) if unique else F.xxhash64("text")
    texts = rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), tie.cast("long").alias("tie"), "text")
    return texts, texts if unique else texts.dropDuplicates(["id", "tie"])


def _batch_words(batch: pa.RecordBatch) -> Iterator[tuple[int, Words]]:
    at = 0
    for part in slices(batch, "text", 2 << 20):
        yield at, split_words(part.column("text"))
        at += part.num_rows


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _anchor_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, id, tie, pos, kind): unique anchors of a batch and one witness of each
    repeated one, to be grouped by anchor; the occurrences of repeated ones are settled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, doc, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for base, w in _batch_words(batch):
                h = w.hashes()
                at = anchors(w, h, window, gram)
                at = at[at >= 0]
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                d = w.doc[at]
                value.append(w.ngrams(gram, h)[at])
                doc.append(d + base)
                pos.append(at - w.first[d])
            v, d, p = map(np.concatenate, (value, doc, pos))
            again, first = _repeated(v)
            use = np.concatenate([np.flatnonzero(~again | first), np.flatnonzero(again)])
            kind = np.full(len(use), _SETTLED, np.int8)
            n = int((~again | first).sum())
            kind[:n] = np.where(again[use[:n]], _WITNESS, _SINGLE)
            ids, ties = batch.column("id").to_numpy()[d[use]], batch.column("tie").to_numpy()[d[use]]
            yield pa.RecordBatch.from_arrays(
                [_long(v[use]), pa.array(ids), pa.array(ties), pa.array(p[use].astype(np.int32)), pa.array(kind)],
                names=["anchor", "id", "tie", "pos", "kind"],
            )

    return texts.mapInArrow(rows, "anchor long, id long, tie long, pos int, kind byte")


def _shared(rows: DataFrame) -> DataFrame:
    """(id, tie, pos) of the anchors that occur more than once; streams over rows sorted by anchor."""
    names = ["id", "tie", "pos"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        matched = False
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            settled = kind == _SETTLED
            yield batch.filter(pa.array(settled)).select(names)
            batch = batch.filter(pa.array(~settled))
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            a = batch.column("anchor").to_numpy()
            same = a[1:] == a[:-1]
            hit = np.zeros(len(a), bool)
            hit[1:] |= same
            hit[:-1] |= same
            hit[0] |= held is not None and matched
            out = hit & (batch.column("kind").to_numpy() == _SINGLE)
            yield batch.slice(0, len(a) - 1).filter(pa.array(out[:-1])).select(names)
            held, matched = batch.slice(len(a) - 1), bool(hit[-1])
        if held is not None and matched and held.column("kind")[0].as_py() == _SINGLE:
            yield held.select(names)

    # settled rows go anywhere: by document
    part = F.when(F.col("kind") == _SETTLED, F.col("id")).otherwise(F.col("anchor"))
    return rows.repartition(part).sortWithinPartitions("anchor").mapInArrow(keep, "id long, tie long, pos int")


def _edge_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(edge, next, id, tie, start, n): windows of the ``shared`` anchors.  n is 0 for the first of its
    kind in a batch, else the row is a run of n windows that occur earlier in the batch.  ``next`` is
    the edge of the window after it, if that is the first of its kind in the batch, too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shared")
            parts = [[np.zeros(0, np.uint64)] for _ in range(2)] + [[np.zeros(0, np.int64)] for _ in range(2)]
            for base, w in _batch_words(batch):
                h = w.hashes()
                at = anchors(w, h, window, gram)
                part = lists.slice(base, len(w.first) - 1)
                sizes = np.diff(part.offsets.to_numpy())
                mark = np.zeros(len(w) + 1, bool)
                mark[part.flatten().to_numpy() + np.repeat(w.first[:-1], sizes)] = True
                use = np.flatnonzero(mark[at] & (at >= 0))
                d = w.doc[use]
                for out, x in zip(parts, (w.ngrams(window, h)[use], w.ngrams(window, w.hashes(1))[use], d + base, use - w.first[d]), strict=True):
                    out.append(x)
            edge, check, d, start = map(np.concatenate, parts)
            ids, ties = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
            order = np.lexsort((start, ties[d], ids[d]))
            edge, check, d, start = edge[order], check[order], d[order], start[order]
            first = _first_of(edge, check)
            rest = np.flatnonzero(~first)
            new = np.ones(len(rest), bool)
            new[1:] = (d[rest[1:]] != d[rest[:-1]]) | (start[rest[1:]] != start[rest[:-1]] + 1)
            head = rest[new]
            runs = np.diff(np.append(np.flatnonzero(new), len(rest)))
            use = np.concatenate([np.flatnonzero(first), head])
            n = np.zeros(len(use), np.int32)
            n[len(use) - len(head) :] = runs
            follows = np.zeros(len(d), bool)
            follows[:-1] = (d[1:] == d[:-1]) & (start[1:] == start[:-1] + 1) & first[1:]
            next_ = np.append(edge[1:], np.zeros(min(1, len(edge)), np.uint64))
            edge = edge[use]
            edge[n > 0] = 0
            yield pa.RecordBatch.from_arrays(
                [_long(edge), pa.array(next_.view(np.int64)[use], mask=~follows[use] | (n > 0)), pa.array(ids[d[use]]), pa.array(ties[d[use]]), pa.array(start[use].astype(np.int32)), pa.array(n)],
                names=["edge", "next", "id", "tie", "start", "n"],
            )

    return texts.mapInArrow(rows, _EDGE)


def _first_of(edge: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its (edge, check), or has an edge whose first row has another check."""
    order = np.argsort(edge, kind="stable")
    e = edge[order]
    head = np.append(True, e[1:] != e[:-1])[: len(e)]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))] if len(e) else order
    out = np.empty(len(e), bool)
    out[order] = head | (check[order] != check[lead])
    return out


def _occurrences(rows: DataFrame) -> DataFrame:
    """The rows of edges that occur more than once, and the settled runs; streams over rows sorted by edge."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        matched = False
        for batch in batches:
            settled = batch.column("n").to_numpy() > 0
            yield batch.filter(pa.array(settled))
            batch = batch.filter(pa.array(~settled))
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            e = batch.column("edge").to_numpy()
            same = e[1:] == e[:-1]
            hit = np.zeros(len(e), bool)
            hit[1:] |= same
            hit[:-1] |= same
            hit[0] |= held is not None and matched
            yield batch.slice(0, len(e) - 1).filter(pa.array(hit[:-1]))
            held, matched = batch.slice(len(e) - 1), bool(hit[-1])
        if held is not None and matched:
            yield held

    # settled rows go anywhere: by document
    part = F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("edge"))
    return rows.repartition(part).sortWithinPartitions("edge").mapInArrow(keep, _EDGE)


def compacted_paths(occurrences: DataFrame) -> DataFrame:
    """(path, n): the first edge and the number of edges of each nonbranching path of the graph of
    ``occurrences`` (edge, next, id, tie, start).

    An edge hangs on another if that one always leads to it and it has no other
    occurrence: both occur equally often.  Every occurrence of ``path`` is
    followed by the path's other edges, so in whatever document has them all
    they are a run; that of smallest hash is looked at.
    """
    number = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    whole = (F.xxhash64("id", "tie").cast("decimal(20,0)") + number(1 << 63)).cast("decimal(20,0)") * number(1 << 31)
    place = (whole.cast("decimal(38,0)") + F.col("start").cast("decimal(10,0)")).cast("decimal(38,0)")
    edges = occurrences.groupBy("edge").agg(F.count("*").alias("n"), F.count("next").alias("led"), F.min("next").alias("low"), F.max("next").alias("high"), F.min(place).alias("place"))
    start = F.pmod("place", number(1 << 31).cast("decimal(38,0)"))
    edges = edges.select("edge", "n", F.when((F.col("led") == F.col("n")) & (F.col("low") == F.col("high")), F.col("low")).alias("next"), (F.col("place") - start).cast("decimal(38,0)").alias("doc"), start.cast("int").alias("start"))
    edges = materialise(edges, "graph-edges")
    ahead = edges.where("next IS NOT NULL").select(F.col("edge").alias("from"), F.col("next").alias("to"), F.col("n").alias("times"))
    tied = edges.join(ahead, (F.col("edge") == F.col("to")) & (F.col("n") == F.col("times")), "left").select("edge", "doc", "start", "from")
    along = Window.partitionBy("doc").orderBy("start", "edge")
    joined = (F.lag("edge").over(along) == F.col("from")) & (F.lag("start").over(along) == F.col("start") - 1)
    heads = tied.withColumn("head", F.when(F.coalesce(joined, F.lit(False)), F.lit(None)).otherwise(F.col("edge")))
    paths = heads.select(F.last("head", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("path"))
    return paths.groupBy("path").agg(F.count("*").cast("int").alias("n"))


def _verified(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """``spans`` (path, n, id, tie, start) with the ``digest`` of the words that they cover in their document."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, w in _batch_words(batch):
                part = batch.slice(base, len(w.first) - 1)
                lists, flat = part.column("spans"), part.column("spans").flatten()
                owner = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                raw, a = w.data.tobytes(), w.first[:-1][owner] + start
                begins, ends = w.starts[a].tolist(), w.ends[a + n + window - 2].tolist()
                found = [hashlib.blake2b(b" ".join(raw[x:y].split()), digest_size=16).digest() for x, y in zip(begins, ends, strict=True)]
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("path"), pa.array(found, pa.binary()), part.column("id").take(rows), part.column("tie").take(rows), flat.field("start"), flat.field("n")],
                    names=["path", "digest", "id", "tie", "start", "n"],
                )

    listed = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("path", "start", "n")).alias("spans"))
    read = texts.join(listed, ["id", "tie"]).select("id", "tie", "text", "spans")
    return read.mapInArrow(digests, "path long, digest binary, id long, tie long, start int, n int")


def repeated_windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = ANCHOR) -> DataFrame:
    """(doc_id, text, runs): every row of ``df`` and the runs (start, n) of its windows that occur earlier."""
    texts, once = _texts(df, doc_id, text)
    shared = materialise(_shared(_anchor_rows(once, window, gram)).groupBy("id", "tie").agg(F.collect_list("pos").alias("shared")), "shared-anchors")
    edges = _edge_rows(once.join(shared, ["id", "tie"]).select("id", "tie", "text", "shared"), window, gram)
    found = materialise(_occurrences(edges), "edge-occurrences")
    again = found.where("n = 0").drop("n")
    paths = materialise(compacted_paths(again), "compacted-paths")
    spans = materialise(again.join(paths, F.col("edge") == F.col("path")).select("path", "n", "id", "tie", "start"), "path-spans")
    read = materialise(_verified(once, spans, window), "verified-spans")
    place = F.struct("id", "tie", "start")
    first = read.groupBy("path", "digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("path", "digest", "first")
    later = read.join(first, ["path", "digest"]).where(place != F.col("first")).select("id", "tie", "start", "n")
    runs = later.unionByName(found.where("n > 0").select("id", "tie", "start", "n")).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    runs = materialise(runs, "repeated-runs")
    return texts.join(runs, ["id", "tie"], "left").select("doc_id", "text", "runs")


def _cover(batch: pa.RecordBatch, words: Words, base: int, window: int) -> np.ndarray:
    """Whether a run covers each word."""
    lists = batch.column("runs").slice(base, len(words.first) - 1)
    sizes = np.zeros(len(lists), np.int64)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    sizes[valid] = np.diff(lists.offsets.to_numpy())[valid]
    flat = lists.drop_null().flatten()
    at = flat.field("start").to_numpy() + np.repeat(words.first[:-1], sizes)
    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + flat.field("n").to_numpy() + window - 1, minlength=len(words) + 1)
    return np.cumsum(edge)[: len(words)] > 0


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = ANCHOR) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept_text, spans.

    A word goes if a window of ``window`` words that covers it also starts
    earlier: at a smaller doc_id, or earlier in the same document.  Windows are
    judged on the input.  ``spans`` are the removed word ranges (start, end).
    Null text has no words and empty kept text.  A null doc_id comes after all
    others.  Rows that share an id but not their text are ordered by a hash of
    the text; rows repeated whole count as one document and get the same result.
    Other columns are ignored; an empty table gives no row.
    """
    return repeated_windows(df, doc_id, text, window, gram).mapInArrow(
        _kept(window, True), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"
    )


def substring_dedup_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = ANCHOR) -> DataFrame:
    """As ``substring_dedup``, with the SHA-256 of the kept words instead of text and spans."""
    return repeated_windows(df, doc_id, text, window, gram).mapInArrow(_kept(window, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(window: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, w in _batch_words(batch):
                n = len(w.first) - 1
                gone = _cover(batch, w, base, window)
                removed = np.append(0, np.cumsum(gone))
                removed = removed[w.first[1:]] - removed[w.first[:-1]]
                raw = w.data.tobytes()
                first, starts, ends = w.first.tolist(), w.starts, w.ends
                kept = []
                for i in range(n):
                    if removed[i]:
                        k = np.arange(first[i], first[i + 1])[~gone[first[i] : first[i + 1]]]
                        kept.append(b" ".join([raw[s:e] for s, e in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]))
                    else:
                        kept.append(b" ".join(raw[w.offsets[i] : w.offsets[i + 1]].split()))
                columns = [batch.column("doc_id").slice(base, n), pa.array(np.diff(w.first)), pa.array(removed)]
                if whole:
                    spans = [[] for _ in range(n)]
                    for i in np.flatnonzero(removed).tolist():
                        g = np.diff(np.concatenate([[0], gone[first[i] : first[i + 1]].astype(np.int8), [0]]))
                        spans[i] = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(g > 0).tolist(), np.flatnonzero(g < 0).tolist(), strict=True)]
                    columns += [pa.array([k.decode() for k in kept]), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])
                else:
                    columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run
