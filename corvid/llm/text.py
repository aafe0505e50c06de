"""Vectorised text kernels over Arrow batches.

Words are the runs of `[^\x20\x09-\x0D]+` of a text. Null texts count as empty. Batches are cut into
pieces of bounded bytes (one long text is a piece of its own), so that memory follows the piece and
not the batch; every text is handled whole.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once by the numpy kernels.
PIECE_BYTES = 8 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def trim() -> None:
    """Gives free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def released(make: Callable) -> Callable:
    """make, a function for mapInArrow; at the end of a task its worker, which waits for others, gives memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from make(batches)
        finally:
            trim()

    return run


def released_table(make: Callable) -> Callable:
    """The same for applyInArrow."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return make(table)
        finally:
            trim()

    return run


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `most` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n+1 offsets; null as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow binary array over contiguous bytes."""
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Words:
    """The words of a piece: ids into `unique`, in order; `bounds` has the n+1 word offsets of its texts."""

    ids: np.ndarray
    unique: pa.Array
    bounds: np.ndarray
    lengths: np.ndarray

    def bytes_of(self) -> list[bytes]:
        return self.unique.to_pylist()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word occurrence, equal on every machine."""
        if not len(self.unique):
            return np.zeros(0, np.uint64)
        h = xxhash.xxh3_64_intdigest
        return np.array([h(w, seed) for w in self.unique.to_pylist()], dtype=np.uint64)[self.ids]

    def __len__(self) -> int:
        return len(self.bounds) - 1


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Splits texts at ASCII white space; lower: A-Z become a-z first."""
    data, offsets = buffers(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64), none)
    word = ~_SPACE[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    starts[first], ends[last] = word[first], word[last]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends)
    lengths = to - at + 1
    kept = data[word]
    if lower:
        kept = _LOWER[kept]
    coded = binary_array(kept, np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode()
    return Words(coded.indices.to_numpy(), coded.dictionary, np.searchsorted(at, offsets), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every k consecutive items of h (len(h) - k + 1 of them), by Horner's rule in `base`, mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b, out = np.uint64(base), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out *= b
            out += h[i : i + n]
    return mix(out)


def doc_of(bounds: np.ndarray, n: int | None = None) -> np.ndarray:
    """For each item its text's number."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ragged(offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that gather the ragged rows `ids` from a flat array with `offsets`, and the new offsets."""
    n = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(n)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    out += np.repeat(offsets[ids] - (ends - n), n)
    return out, np.concatenate([[0], ends])


def segments(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Hash of h[s : s + n] for each (s, n): differences of prefix sums of h[j] * base**j, shifted back and mixed."""
    b, inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = np.full(len(h) + 1, b, np.uint64)
        powers[:1] = 1
        np.cumprod(powers, out=powers)
        back = np.full(len(h) + 1, inverse, np.uint64)
        back[:1] = 1
        np.cumprod(back, out=back)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers[:-1], out=sums[1:])
        return mix((sums[starts + lengths] - sums[starts]) * back[starts] + lengths.astype(np.uint64))


def lists(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (from 0) and flat values of a list column; null lists as empty."""
    n = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), array.flatten()
