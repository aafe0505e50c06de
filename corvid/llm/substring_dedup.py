"""Substring deduplication over a log-structured fingerprint index.

A window is `width` consecutive words of one document. Of the `width - gram + 1` word k-grams of a
window, the leftmost one of least hash stands for it: equal windows choose equal k-grams, and a run
of neighbouring windows shares one choice, so the index holds one row per run (about 7 % of the
words) and not one per window. A row has the k-gram's hash, a hash of all words the run spans and the
run's place. Each appended batch becomes an immutable run of sorted files.

A batch is merge-joined with all runs on the k-gram's hash. Runs whose whole span is equal to
another's repeat entirely; where k-grams are equal but spans differ (the edges of a repeat), every
window of one representative per distinct span is verified by a 128-bit digest of its 35 words. All
counts come from partial aggregates, so that a passage which a third of all rows share never meets in
one task; the joins have a unique side and AQE may split the other.

Defined cases: null or empty text has no words; a text shorter than a window keeps all words; rows
with equal doc_id and text are separate documents that repeat each other; null doc_ids are allowed;
columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import text as T
from corvid.llm.scratch import bounded_batches, fresh_dir, remove, row_digest, stage

_A, _B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_ROW = "doc_id long, row_hash binary"
_RUN = f"fp long, span long, {_ROW}, first int, n int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _leftmost_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the leftmost place of the least g[i : i + width]; the last width - 1 are not defined."""
    value, place, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        value = np.concatenate([np.where(right, value[step:], value[:-step]), value[len(value) - step :]])
        place = np.concatenate([np.where(right, place[step:], place[:-step]), place[len(place) - step :]])
        have += step
    return place


def fingerprint_runs(w: T.Words, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, k-gram hash, span hash, first window, windows) of each run of windows that share a k-gram."""
    n_windows = np.maximum(np.diff(w.bounds) - width + 1, 0)
    if not n_windows.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = w.hashes()
    g = T.windows(h, gram, _A)
    best = _leftmost_minimum(g, width - gram + 1)
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    rel = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = w.bounds[doc] + rel
    place = best[at]
    new = np.ones(len(doc), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc)))
    span = T.segments(w.hashes(1), at[first], n + width - 1, _B)
    return doc[first], g[place[first]], span, rel[first], n


class FingerprintIndex:
    """Immutable runs below a folder of the shared store.

    width: words of a window; gram: words of a k-gram, at most width.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = 35, gram: int = 10):
        if not 1 <= gram <= width:
            raise ValueError("gram must be from 1 to width")
        self.spark, self.width, self.gram = spark, width, gram
        self.path = path or fresh_dir(spark, "fingerprints")
        self.runs: list[str] = []
        self._made = 0

    def _docs(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(F.col("text")).alias("row_hash"), "text")

    def _name(self, kind: str) -> str:
        self._made += 1
        return f"{self.path}/{kind}-{self._made:05d}"

    def append(self, docs: DataFrame) -> DataFrame:
        """Fingerprints a batch into a new run, each file of it sorted, and returns that run."""
        width, gram = self.width, self.gram

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in T.pieces(batch):
                    doc, fp, span, first, n = fingerprint_runs(T.words(T.column(x, "text")), width, gram)
                    if len(doc):
                        at = pa.array(doc)
                        yield pa.RecordBatch.from_arrays(
                            [_signed(fp), _signed(span), T.column(x, "doc_id").take(at), T.column(x, "row_hash").take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                            ["fp", "span", "doc_id", "row_hash", "first", "n"],
                        )

        path = self._name("run")
        self._docs(docs).mapInArrow(rows, _RUN).sortWithinPartitions("fp").write.parquet(path)
        self.runs.append(path)
        return self._read([path])

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*paths)

    def compact(self) -> None:
        """Merges all runs into one, sorted by fingerprint, and drops the merged ones."""
        if len(self.runs) < 2:
            return
        path = self._name("compacted")
        self._read(self.runs).repartition("fp").sortWithinPartitions("fp").write.parquet(path)
        old, self.runs = self.runs, [path]
        for p in old:
            remove(self.spark, p)

    def deduplicate(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Appends docs as a run and drops their words in windows that start elsewhere too.

        Elsewhere: in docs themselves or in an earlier batch. history: the documents of the earlier
        batches, where their runs' places are looked up for verification. Returns doc_id, n_words,
        n_removed and kept_text (kept words joined by one space), one row per row of docs.
        """
        bounded_batches(self.spark)
        earlier = list(self.runs)
        if earlier and history is None:
            raise ValueError("the documents of earlier batches are needed to verify hits")
        new = self.append(docs).withColumn("new", F.lit(True))
        found = new.unionByName(self._read(earlier).withColumn("new", F.lit(False))) if earlier else new
        repeated = found.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select("fp")
        suspects = stage(found.join(repeated, "fp"), "suspects")
        key = ["fp", "span", "n"]
        spans = stage(suspects.groupBy(*key).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "row_hash", "first")).alias("at"), F.bool_or("new").alias("new")), "spans")
        whole = suspects.filter("new").join(spans.filter("c > 1").select(*key), key).select("doc_id", "row_hash", "first", "n")

        edges = spans.groupBy("fp").agg(F.count("*").alias("spans"), F.min("c").alias("least")).filter("spans > 1 and least = 1").select("fp")
        ask = spans.join(edges, "fp").groupBy("at.doc_id", "at.row_hash").agg(F.collect_list(F.struct("at.first", "n", (F.col("c") == 1).alias("open"))).alias("ask"))
        texts = self._docs(docs) if history is None else self._docs(docs).unionByName(self._docs(history))
        digests = self._digests(self._with(texts, ask, "inner"))
        twice = digests.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").select("w1", "w2")
        edge = digests.filter("open").join(twice, ["w1", "w2"]).select("doc_id", "row_hash", "first", F.lit(1).alias("n"))
        cover = whole.unionByName(edge).groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("first", "n")).alias("cover"))
        return self._cut(self._with(self._docs(docs), cover, "left"))

    @staticmethod
    def _with(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
        """docs with the list of each row; null doc_ids are equal to each other here."""
        r = lists.withColumnsRenamed({"doc_id": "_id", "row_hash": "_hash"})
        return docs.join(r, docs.doc_id.eqNullSafe(r._id) & (docs.row_hash == r._hash), how).drop("_id", "_hash")

    def _digests(self, asked: DataFrame) -> DataFrame:
        width = self.width

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in T.pieces(batch):
                    w = T.words(T.column(x, "text"))
                    off, flat = T.lists(T.column(x, "ask"))
                    runs, n = T.doc_of(off), flat.field("n").to_numpy().astype(np.int64)
                    run = np.repeat(np.arange(len(n)), n)
                    first = flat.field("first").to_numpy().astype(np.int64)[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                    doc = runs[run]
                    at, wide = w.bounds[doc] + first, np.full(len(first), width)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(T.segments(w.hashes(2), at, wide, _A)), _signed(T.segments(w.hashes(3), at, wide, _B)), T.column(x, "doc_id").take(pa.array(doc)), T.column(x, "row_hash").take(pa.array(doc)), pa.array(first.astype(np.int32)), flat.field("open").take(pa.array(run))],
                        ["w1", "w2", "doc_id", "row_hash", "first", "open"],
                    )

        return asked.select("doc_id", "row_hash", "text", "ask").mapInArrow(rows, f"w1 long, w2 long, {_ROW}, first int, open boolean")

    def _cut(self, covered: DataFrame) -> DataFrame:
        width = self.width

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in T.pieces(batch):
                    w = T.words(T.column(x, "text"))
                    off, flat = T.lists(T.column(x, "cover"))
                    at = w.bounds[T.doc_of(off)] + flat.field("first").to_numpy()
                    step = np.zeros(len(w.ids) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + flat.field("n").to_numpy() + width - 1, -1)
                    kept = np.cumsum(step)[:-1] == 0
                    before = np.concatenate([[0], np.cumsum(kept)])
                    bounds = before[w.bounds]
                    spaced = pa.array([v + b" " for v in w.bytes_of()], pa.binary())
                    _, _, data = spaced.take(pa.array(w.ids[kept])).buffers()
                    ends = np.concatenate([[0], np.cumsum(w.lengths[kept] + 1)])[bounds]
                    view = memoryview(data) if data is not None else memoryview(b"")
                    texts = [str(view[a : max(a, b - 1)], "utf-8") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    n = np.diff(w.bounds)
                    yield pa.RecordBatch.from_arrays([T.column(x, "doc_id"), pa.array(n), pa.array(n - np.diff(bounds)), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

        return covered.select("doc_id", "text", "cover").mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_text string")
