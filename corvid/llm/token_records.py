"""Token ids in length-delimited binary record files with a separate offset index.

A data file is a sequence of frames: length of the payload (u64), masked checksum of those 8 bytes
(u32), payload, masked checksum of the payload (u32), all little-endian. The payload is the doc_id (i64)
and the ids, in 2 bytes each where the vocabulary fits, else 4. The checksum is CRC-32, masked by a
rotation and a constant so that checksums of checksums differ. The index file has a header and one entry
of (doc_id, offset, ids) per frame: a reader can seek to any record, in any order, and check it alone.

Documents are range-partitioned by doc_id, one file per partition, in ascending order within and across
files. A task writes under a name of its own and renames when complete, so that repeated or lost tasks
leave whole files only.

Defined cases: null text counts as empty and has the end id alone; null doc_ids come first and are
marked in the index; equal doc_ids stay separate records, in the order of their texts' digests, so that
reruns agree; a very long text is one record; columns other than doc_id and text are
ignored; an empty table gives no records.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm import text as T
from corvid.llm.scratch import bounded_batches, fresh_dir, row_digest, stage

_MASK = 0xA282EAD8
#: Index header: magic, bytes of an id, entries.
_HEADER = "<8sII"
_MAGIC = b"CRVTOKEN"
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("offset", "<i8"), ("ids", "<i8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the frame at a position, checked, and the position after it."""
    view = memoryview(data)
    head = bytes(view[at : at + 8])
    if len(head) < 8 or struct.unpack_from("<I", view, at + 8)[0] != masked(head):
        raise ValueError(f"the length at {at} does not match its checksum")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = view[at + 12 : end]
    if len(view) < end + 4 or struct.unpack_from("<I", view, end)[0] != masked(payload):
        raise ValueError(f"the record at {at} does not match its checksum")
    return payload, end + 4


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class Encoder:
    """Encodes whole texts with a tokenizers file, each distinct word of a piece once.

    The file's normaliser and pre-tokeniser break at white space and its added tokens hold none, so that
    words can be encoded alone.
    A worker remembers the ids of at most about `remember` words, over tasks too.
    """

    def __init__(self, path: str, end: int, remember: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.remember = end, remember
        self.memo: dict[bytes, bytes] = {}
        # An added token that the library cuts out as it is, before anything else, separates words that are encoded in one call.
        self.mark = next(((x.content, i) for i, x in self.tokenizer.get_added_tokens_decoder().items() if not (x.normalized or x.lstrip or x.rstrip or x.single_word) and x.content[:1] == "<" and x.content[-1:] == ">"), None)
        if self.tokenizer.truncation or self.tokenizer.padding:
            self.mark = None
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4")

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids(self, words: list[str], together: int = 32) -> list[bytes]:
        """The ids of each word, as if encoded alone; words that could hold or become part of an added token are."""
        if self.mark is None:
            return self._alone(words)
        out: list[bytes] = [b""] * len(words)
        apart = [i for i, x in enumerate(words) if "<" in x or ">" in x]
        for i, x in zip(apart, self._alone([words[i] for i in apart]), strict=True):
            out[i] = x
        skip = set(apart)
        rest = [i for i in range(len(words)) if i not in skip]
        text, mark = self.mark
        lines = [text.join([words[i] for i in rest[a : a + together]]) + text for a in range(0, len(rest), together)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)), self.dtype)
        ends = np.flatnonzero(flat == mark)
        if len(ends) != len(rest):  # the mark's id stands for something else too
            return self._alone(words)
        data, width, a = flat.tobytes(), self.dtype.itemsize, 0
        for i, b in zip(rest, (ends * width).tolist(), strict=True):
            out[i], a = data[a:b], b + width
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and their n+1 offsets."""
        w, memo = T.words(texts), self.memo
        if len(memo) > self.remember:
            memo.clear()
        unique = w.bytes_of()
        new = [x for x in unique if x not in memo]
        memo.update(zip(new, self._ids([x.decode() for x in new]), strict=True))
        coded = [memo[x] for x in unique]
        flat = np.frombuffer(b"".join(coded), self.dtype)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in coded], dtype=np.int64)]) // self.dtype.itemsize
        places, ends = T.ragged(starts, w.ids)
        own = ends[w.bounds]
        out = np.empty(len(places) + len(w), self.dtype)
        last = own[1:] + np.arange(len(w))
        rest = np.ones(len(out), bool)
        rest[last] = False
        out[last], out[rest] = self.end, flat[places]
        return out, own + np.arange(len(w) + 1)


@lru_cache(maxsize=2)
def encoder_of(path: str, end: int) -> Encoder:
    """One encoder per worker."""
    return Encoder(path, end)


def write_records(docs: DataFrame, path: str, tokenizer: str, end: int = 1, partitions: int | None = None) -> DataFrame:
    """Writes files below path; returns their manifest (shard, file, records, tokens), one row per file.

    tokenizer: a file path that every executor has.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(tokenizer, end), TaskContext.get()
        name, entries, offset = f"tokens-{task.partitionId():05d}", [], 0
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        own = f"{root}/_{name}-{task.taskAttemptId()}"
        with fs.open_output_stream(own) as out:
            for batch in batches:
                for x in T.pieces(batch):
                    ids, off = encoder.encode(T.column(x, "text"))
                    data, at, width = memoryview(ids).cast("B"), off.tolist(), encoder.dtype.itemsize
                    for doc, a, b in zip(T.column(x, "doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                        framed = frame(struct.pack("<q", doc or 0) + data[a * width : b * width])
                        out.write(framed)
                        entries.append((doc or 0, doc is None, offset, b - a))
                        offset += len(framed)
        index = np.array(entries, _ENTRY)
        with fs.open_output_stream(f"{own}.index") as out:
            out.write(struct.pack(_HEADER, _MAGIC, encoder.dtype.itemsize, len(index)) + index.tobytes())
        for tail, final in (("", ".rec"), (".index", ".idx")):
            fs.move(own + tail, f"{root}/{name}{final}")
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "file": f"{path}/{name}", "records": len(index), "tokens": int(index["ids"].sum())}])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["doc_id", "_digest"]  # equal doc_ids spread over files too, and have one order
    ordered = rows.withColumn("_digest", row_digest(F.col("text"))).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_digest")
    return stage(ordered.mapInArrow(write, "shard long, file string, records long, tokens long"), "manifest")


class RecordFile:
    """Random access to one data file through its index."""

    def __init__(self, file: str):
        self.fs, self.root = _fs(file)
        with self.fs.open_input_stream(f"{self.root}.idx") as f:
            raw = f.read()
        magic, width, n = struct.unpack_from(_HEADER, raw)
        if magic != _MAGIC:
            raise ValueError(f"{file} has no index of this format")
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.index = np.frombuffer(raw, _ENTRY, n, struct.calcsize(_HEADER))

    def records(self, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the records, in file order or as `order` says, each checked."""
        width = self.dtype.itemsize
        with self.fs.open_input_file(f"{self.root}.rec") as f:
            for i in range(len(self.index)) if order is None else order:
                e = self.index[i]
                f.seek(int(e["offset"]))
                payload, _ = unframe(f.read(24 + int(e["ids"]) * width))
                yield (None if e["null"] else struct.unpack_from("<q", payload)[0]), np.frombuffer(payload, self.dtype, offset=8)


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids of every record, read back from the files in order.

    start counts the ids before the record in all files; the manifest has one row per file.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before.cast("long")).filter("records > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, rows, size = row["base"], [], 0
                for doc, ids in RecordFile(row["file"]).records():
                    rows.append((doc, at, len(ids), ids.astype("<u4").tobytes()))
                    at, size = at + len(ids), size + len(ids) * 4
                    if size > T.PIECE_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "base").repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def encoded(docs: DataFrame, tokenizer: str, end: int = 1, path: str | None = None) -> DataFrame:
    """Writes docs to record files and returns what is read back from them."""
    spark: SparkSession = docs.sparkSession
    return read_records(write_records(docs, path or fresh_dir(spark, "records"), tokenizer, end))
