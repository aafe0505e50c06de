"""Toxicity by a factorization machine over hashed terms.

A term is a word with A-Z lower-cased and ASCII punctuation stripped from both ends, or a stem of it (its
first bytes), hashed to `dims` buckets; a document has a term once. The score is the logistic of
bias + sum of w_i + sum over pairs of <v_i, v_j>, so that two terms that mean little alone (an insult, a
group's mention) can weigh together. Only labels and terms of the text are learnt from: never language,
source or doc_id.

The model is fitted on a bounded sample: the `sample_rows` labelled rows of least id hash among those
that may be learnt from, one text each. Buckets whose share among toxic documents does not differ by
`least_z` standard errors keep weight 0, so that rare words of the sample add no noise; they are left out
by partial counts before the driver gets the sample's terms. All documents are scored in one pass, with a
model of at most dims entries.

Defined cases: null or empty texts have no terms and get the bias alone; without both labels in the
sample the score is the share of toxic labels, or 0 without labels; rows that repeat are scored each on
its own, and of rows that share a labelled doc_id the greatest text is learnt from; very long texts are
scored whole, as pieces of their own; columns other than doc_id and text (labels: doc_id and toxic) are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import text as T
from corvid.llm.scratch import bounded_batches, stage

#: Bytes of the stems that are terms beside the whole word, so that inflected forms share evidence.
STEMS = (5, 7)

#: Bytes of text handled at once, and of an Arrow batch.
PIECE_BYTES, BATCH = 512 << 10, "2m"

#: Standard errors by which a bucket's share among toxic documents must differ for a weight.
LEAST_Z = 4.0
_STRIP = string.punctuation.encode()


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Rows whose crc32(doc_id as text) mod folds is `fold`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def terms(texts: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of all texts, one after another, and their n+1 offsets."""
    w, h = T.words(texts, lower=True), xxhash.xxh3_64_intdigest
    doc, coded = T.doc_of(w.bounds), []
    stripped = [x.strip(_STRIP) for x in w.bytes_of()]
    for seed, most in enumerate((None, *STEMS)):
        of = np.array([h(x[:most], seed) % dims if x else -1 for x in stripped], np.int64)
        buckets = of[w.ids] if len(w.ids) else np.zeros(0, np.int64)
        coded.append(doc[buckets >= 0] * dims + buckets[buckets >= 0])
    distinct = np.unique(np.concatenate(coded))
    return distinct % dims, np.searchsorted(distinct, np.arange(len(w) + 1) * dims)


@dataclass
class Machine:
    """buckets: sorted, with a weight and a factor row each."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    dims: int

    def scores(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of texts from their distinct buckets."""
        known = np.isin(found, self.buckets)
        at, doc = np.searchsorted(self.buckets, found[known]), T.doc_of(offsets)[known]
        return _logistic(_raw(self.bias, self.weights, self.factors, at, doc, len(offsets) - 1)[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _raw(bias: float, w: np.ndarray, v: np.ndarray, at: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores, and the sum of factors per document."""
    out = bias + np.bincount(doc, w[at], n)
    sums = np.zeros((n, v.shape[1]))
    for f in range(v.shape[1]):  # one factor at a time bounds the memory
        x = v[at, f]
        sums[:, f] = np.bincount(doc, x, n)
        out += 0.5 * (sums[:, f] ** 2 - np.bincount(doc, x * x, n))
    return out, sums


def fit(found: np.ndarray, offsets: np.ndarray, labels: np.ndarray, dims: int, factors: int = 8, least_z: float = LEAST_Z, epochs: int = 300, rate: float = 0.05, decay: tuple[float, float] = (1e-6, 1e-4), seed: int = 7) -> Machine:
    """A machine from the distinct buckets of all documents, their n+1 offsets and labels 0 or 1, by Adam on the mean logistic loss.

    The first third of the steps fits the additive weights alone, so that a term which is enough by itself gets its weight there.
    """
    n, share = len(labels), float(labels.mean()) if len(labels) else 0.0
    none = np.zeros(0)
    if not 0 < share < 1:
        return Machine(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), none.astype(np.int64), none, np.zeros((0, factors)), dims)
    sizes = np.diff(offsets)
    have, toxic = np.bincount(found, minlength=dims), np.zeros(dims)
    for i in np.flatnonzero(labels):  # a document has a bucket once
        toxic[found[offsets[i] : offsets[i + 1]]] += labels[i]
    error = np.sqrt(np.maximum(have * share * (1 - share), 1e-9))
    chosen = (have > 0) & (np.abs(toxic - have * share) / error >= least_z)
    keep = chosen[found]
    buckets = np.flatnonzero(chosen)
    at, doc = (np.cumsum(chosen) - 1)[found[keep]], np.repeat(np.arange(n, dtype=np.int32), sizes)[keep]
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), factors))]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        raw, sums = _raw(params[0][0], params[1], params[2], at, doc, n)
        g = (_logistic(raw) - labels) / n
        each = g[doc]
        grads = [np.array([g.sum()]), np.bincount(at, each, len(buckets)) + decay[0] * params[1], np.stack([np.bincount(at, each * (sums[doc, f] - params[2][at, f]), len(buckets)) for f in range(factors)], axis=1) + decay[1] * params[2]]
        for p, d, m, s in list(zip(params, grads, mean, var, strict=True))[: 2 if step <= epochs // 3 else 3]:
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), buckets, params[1], params[2], dims)


def train(docs: DataFrame, labels: DataFrame, dims: int = 1 << 20, sample_rows: int = 12_000, **options) -> Machine:
    """Fits on at most sample_rows labelled documents, none of them held out."""
    bounded_batches(docs.sparkSession, BATCH)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).filter("_toxic IS NOT NULL AND _id IS NOT NULL").filter(~held_out(F.col("_id")))
    chosen = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.max("text").alias("text"), F.max("_toxic").alias("_toxic"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in T.pieces(batch, most=PIECE_BYTES):
                found, off = terms(T.column(x, "text"), dims)
                yield pa.RecordBatch.from_arrays([T.column(x, "_toxic").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(found.astype(np.int32)))], ["toxic", "terms"])

    listed = stage(sample.select("text", "_toxic").mapInArrow(T.released(make), "toxic int, terms array<int>"), "terms")
    seen = listed.agg(F.count("*"), F.avg("toxic")).first()
    chosen_terms = np.zeros(0, np.int32)
    if seen[0]:
        least_z, share = options.get("least_z", LEAST_Z), seen[1]
        error = F.sqrt(F.greatest(F.col("n") * share * (1 - share), F.lit(1e-9)))
        counts = listed.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
        chosen_terms = np.sort(counts.filter(F.abs(F.col("toxic") - F.col("n") * share) / error >= least_z).select("term").toArrow().column("term").to_numpy())

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            off, flat = T.lists(T.column(x, "terms"))
            keep = np.isin(flat.to_numpy(), chosen_terms)
            ends = np.concatenate([[0], np.cumsum(keep)])[off]
            yield pa.RecordBatch.from_arrays([T.column(x, "toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep)))], ["toxic", "terms"])

    rows = listed.mapInArrow(few, "toxic int, terms array<int>").toArrow()
    off, flat = T.lists(rows.column("terms").combine_chunks()) if rows.num_rows else (np.zeros(1, np.int64), pa.array([], pa.int32()))
    machine = fit(flat.to_numpy(), off, rows.column("toxic").to_numpy().astype(float), dims, **options)
    del rows, flat, off
    T.trim()
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in T.pieces(batch, most=PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([T.column(x, "doc_id"), pa.array(shared.value.scores(*terms(T.column(x, "text"), shared.value.dims)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.released(make), "doc_id long, score double")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in T.pieces(batch, most=PIECE_BYTES):
                yield x.filter(pa.array(shared.value.scores(*terms(T.column(x, "text"), shared.value.dims)) < threshold))

    return docs.mapInArrow(T.released(make), docs.schema)
