"""Soft-membership mixing of sources to target token totals.

Domains come from the labelled table: clean text of high quality, clean text of
low quality, toxic text.  A classifier learnt from it (boosted trees, one
against the rest, over document statistics and word log odds) gives every
document its domain posteriors.  A document of n tokens and posteriors p
sampled at rate r adds r * n * p[d] expected tokens to domain d.  Rates r >= 0
are fitted by projected gradient on the least squares of the domains' totals
against their targets, from r = 1 on:

    r <- max(0, r - p . g),   g = G^-1 (totals - targets),   G = sum n p p^T over r > 0

(the gradient is scaled by the documents that can still move either way, which
makes the step length 1).  A round is one aggregation over (n, p); only domain totals come to
the driver, and a document's rate follows from its own p and the rounds' g, so
rates are never shuffled, joined or stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbt import Forest, fit
from .quality import document_statistics
from .storage import materialise
from .tokens import encoder, tokenizer_path
from .words import slices, split_words

DOMAINS = ("high", "low", "toxic")
#: Production targets, as multiples of the corpus' own expected domain totals.
MULTIPLES = {"high": 1.25, "low": 0.5, "toxic": 0.05}
#: Labelled documents to learn from: those of smallest id hash, if there are more.
TRAIN_ROWS = 20_000
ROUNDS = 40
#: Rounds end when no total misses its target by more than this share of all tokens, or when that hasn't come closer for PATIENCE rounds.
TOLERANCE, PATIENCE = 1e-5, 8

_BUCKETS = 1 << 16
_LEAST_DOCS = 5


@dataclass
class DomainModel:
    """``odds``: domains x buckets; ``forests``: one a domain."""

    odds: np.ndarray
    forests: list[Forest]

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        """Domain shares of each text, which add up to 1."""
        x = self.features(texts)
        p = np.stack([f.score(x) for f in self.forests], 1)
        return p / p.sum(1, keepdims=True)

    def features(self, texts: pa.Array) -> np.ndarray:
        w = split_words(texts)
        h = w.hashes()
        bucket = (h % np.uint64(_BUCKETS)).astype(np.int64)
        n = np.diff(w.first)
        some = np.flatnonzero(n)
        columns = [document_statistics(texts, w, h)]
        for odds in self.odds:
            v = odds[bucket]
            out = np.zeros((len(n), 4))
            if len(some):
                at = w.first[some]
                out[some, 0] = np.maximum.reduceat(v, at)
                out[some, 1] = np.add.reduceat(v, at) / n[some]
                out[some, 2] = np.add.reduceat((v > 1.5).astype(float), at)
                out[some, 3] = out[some, 2] / n[some]
            columns.append(out)
        return np.concatenate(columns, 1)


def labelled_domains(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, domain, half) of at most ``rows`` labelled ids, so bounded for a broadcast; toxic
    beats low beats high where an id has several rows.  Rows without id or labels don't count."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    one = good.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(domain).alias("domain"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return one.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))


def train_domains(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DomainModel:
    """Word log odds from one half of the labelled documents, trees from the other.  An id that
    repeats in ``df`` gives one row, with its smallest text."""
    sample = labelled_domains(labels, rows)
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "domain", "half").agg(F.min("text").alias("text"))
    texts = materialise(texts, "labelled-texts")
    k = len(DOMAINS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = split_words(part.column("text"))
                bucket = (w.hashes() % np.uint64(_BUCKETS)).astype(np.int64)
                seen = np.unique(w.doc * _BUCKETS + bucket)
                domain = part.column("domain").to_numpy().astype(np.int64)
                key, n = np.unique(domain[seen // _BUCKETS] * _BUCKETS + seen % _BUCKETS, return_counts=True)
                docs = np.bincount(domain, minlength=k)
                key, n = np.append(key, k * _BUCKETS + np.arange(k)), np.append(n, docs)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    counts = texts.where("half = 0").select("text", "domain").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    table = np.zeros(k * _BUCKETS + k)
    for r in counts.collect():  # at most domains * (buckets + 1) rows
        table[r.key] = r.n
    df_, docs = table[: k * _BUCKETS].reshape(k, _BUCKETS), table[k * _BUCKETS :]
    rest, rest_docs = df_.sum(0) - df_, docs.sum() - docs
    odds = np.log((df_ + 0.5) / (docs[:, None] + 1)) - np.log((rest + 0.5) / (rest_docs[:, None] + 1))
    odds[:, df_.sum(0) < _LEAST_DOCS] = 0
    model = DomainModel(odds.astype(np.float32), [])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = model.features(part.column("text"))
                at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("domain"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["domain", "x"])

    found = texts.where("half = 1").select("domain", "text").mapInArrow(features, "domain int, x array<double>").collect()
    found.sort(key=lambda r: (r.domain, r.x))
    x, y = np.array([r.x for r in found], float), np.array([r.domain for r in found], int)
    x = x if len(x) else np.zeros((0, 1))
    forests = [fit(x, (y == d).astype(float)) for d in range(k)]
    return DomainModel(model.odds, forests)


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def domain_sums(n: np.ndarray, p: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The expected domain totals at ``rate``, and the sums of n p p^T over rows of positive rate, in a row."""
    active = p * (n * (rate > 0))[:, None]
    return np.concatenate([(rate * n) @ p, (active.T @ p).ravel()])


def descend(sums: Callable[[list[np.ndarray]], np.ndarray], goal: Callable[[np.ndarray], np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The g of the rounds up to the closest one.  ``sums`` gives ``domain_sums`` after some steps, ``goal`` the targets from the totals at rate 1."""
    steps: list[np.ndarray] = []
    best, kept, want = np.inf, 0, None
    while True:
        found = sums(steps)
        k = round((np.sqrt(4 * len(found) + 1) - 1) / 2)
        totals, gram = found[:k], found[k:].reshape(k, k)
        want = goal(totals) if want is None else want
        error = totals - want
        size = np.abs(error).max() / max(1.0, want.sum())
        if size < best:
            best, kept = size, len(steps)
        if best <= TOLERANCE or len(steps) == rounds or len(steps) - kept >= PATIENCE:
            return steps[:kept]
        steps.append(np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ error)


def fit_steps(scored: DataFrame, targets: Mapping[str, float] | None, multiples: Mapping[str, float], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The g of each round, for (n_tokens, p_<domain>...) rows.  ``targets`` are token totals;
    without them ``multiples`` of the domains' totals at rate 1 are."""
    k = len(DOMAINS)
    names = [f"p_{d}" for d in DOMAINS]
    schema = ", ".join([f"s{i} double" for i in range(k)] + [f"g{i} double" for i in range(k * k)])

    def sums(steps: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for batch in batches:
                n = batch.column("n_tokens").to_numpy().astype(float)
                p = np.stack([batch.column(c).to_numpy() for c in names], 1)
                total += domain_sums(n, p, _rates(p, steps))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=[f.split()[0] for f in schema.split(", ")])

        row = scored.select("n_tokens", *names).mapInArrow(run, schema)
        return np.array([v or 0.0 for v in row.agg(*(F.sum(c).alias(c) for c in row.columns)).first()])

    return descend(sums, lambda totals: np.array([float(targets[d]) if targets is not None else multiples[d] * t for d, t in zip(DOMAINS, totals, strict=True)]), rounds)


def _score(df: DataFrame, model: DomainModel, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.posteriors(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(enc.counts(part.column("text"))), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"{c} double" for c in names[2:]))


def _share(ids: np.ndarray) -> np.ndarray:
    """A number in [0, 1) from an id."""
    from .words import mix64

    return (mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / (1 << 53)


def _copies(rate: np.ndarray, ids: np.ndarray) -> np.ndarray:
    whole = np.floor(rate)
    return (whole + (_share(ids) < rate - whole)).astype(np.int64)


def fit_mixture(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", targets: Mapping[str, float] | None = None,
                multiples: Mapping[str, float] = MULTIPLES, tokenizer: str | None = None) -> tuple[DomainModel, DataFrame, list[np.ndarray]]:
    model = train_domains(df, labels, doc_id, text)
    scored = materialise(_score(df, model, doc_id, text, tokenizer or tokenizer_path()), "mixture")
    return model, scored, fit_steps(scored, targets, multiples)


def mixing_rates(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", targets: Mapping[str, float] | None = None,
                 multiples: Mapping[str, float] = MULTIPLES, tokenizer: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, p_high, p_low, p_toxic, rate, copies.

    ``copies`` is the rate rounded down or up, up with the rate's fraction as
    probability (by a hash of the id), so its expectation is the rate.  Null and
    empty texts have no tokens and a rate like any other; rows that share an id
    round alike; a null id rounds like id 0.  Without labels all posteriors are equal.
    Targets that no rates reach are approached in the least squares.  Other
    columns are ignored; an empty table gives no row.
    """
    _, scored, steps = fit_mixture(df, labels, doc_id, text, targets, multiples, tokenizer)
    names = scored.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(c).to_numpy() for c in names[2:]], 1) if batch.num_rows else np.zeros((0, len(DOMAINS)))
            rate = _rates(p, steps)
            copies = _copies(rate, batch.column("doc_id").fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate), pa.array(copies)], names=[*names, "rate", "copies"])

    return scored.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in scored.dtypes) + ", rate double, copies long")


def mix_documents(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", targets: Mapping[str, float] | None = None,
                  multiples: Mapping[str, float] = MULTIPLES, tokenizer: str | None = None) -> DataFrame:
    """The rows of ``df`` with all their columns, each as often as ``copies`` of
    ``mixing_rates`` says, nulls and repeated rows as there.  One more pass over the text instead of a join."""
    model, _, steps = fit_mixture(df, labels, doc_id, text, targets, multiples, tokenizer)
    names = [f"c{i}" for i in range(len(df.columns))]
    at_text = "text"
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_text):
                rate = _rates(model.posteriors(part.column("text")), steps)
                copies = _copies(rate, part.column("id").fill_null(0).to_numpy())
                yield part.select(names).take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    return rows.mapInArrow(run, rows.select(*names).schema).withColumnsRenamed(dict(zip(names, df.columns, strict=True)))
