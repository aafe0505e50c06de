"""Elias-Fano sequences over memory-mapped arrays, with vectorised access and successor search.

A monotone sequence of n numbers below u keeps the low floor(log2(u / n)) bits of each number packed, and
the rest in unary: bit (high + i) is set for the i-th number. A directory of set bits before each 64-bit
word makes access and successor search a few array operations.
"""

from __future__ import annotations

import io
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs

#: Halves of a word, and of its halves, with the masks of their lower ones.
_HALVES = [(np.uint64(w), np.uint64((1 << w) - 1)) for w in (32, 16, 8, 4, 2, 1)]

#: Words between those whose zeros are counted in memory; a power of 2.
_STEP = 64


def save(path: str, array: np.ndarray) -> None:
    """Writes one array; the name appears when the file is whole, so that a task can be run again."""
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root.rpartition("/")[0], recursive=True)
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    own = f"{root}.{np.random.default_rng().integers(1 << 62):x}"
    with fs.open_output_stream(own) as f:
        f.write(out.getbuffer())
    fs.move(own, root)


@lru_cache(maxsize=None)
def _cache() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="corvid-map-")


def load(path: str) -> np.ndarray:
    """Maps one array into memory; from a store that is not mounted it is copied to a temporary file of this process first."""
    fs, root = pafs.FileSystem.from_uri(path)
    if not isinstance(fs, pafs.LocalFileSystem):
        local = f"{_cache().name}/{root.replace('/', '_')}"
        pafs.copy_files(root, local, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        root = local
    return np.asarray(np.load(root, mmap_mode="r"))


def _select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th set bit of each word: into the upper half where the lower one has too few."""
    rest, left, place = words.astype(np.uint64, copy=True), r.astype(np.int16), np.zeros(len(words), np.uint64)
    for width, mask in _HALVES:
        have = np.bitwise_count(rest & mask)
        up = left >= have
        left -= have * up
        shift = width * up
        rest >>= shift
        place += shift
    return place.astype(np.int64)


def _next_bit(rest: np.ndarray) -> np.ndarray:
    """The place of the lowest set bit of words that have one."""
    return np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))


def _above(at: np.ndarray) -> np.ndarray:
    """Words with all bits above a place set."""
    return ~((np.uint64(2) << at.astype(np.uint64)) - np.uint64(1))


class EliasFano:
    """n numbers; parts: lows (packed), bits (unary highs) and ranks (set bits before each word)."""

    def __init__(self, n: int, low: int, lows: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.n, self.low, self.lows, self.bits, self.ranks = n, low, lows, bits, ranks
        self.zeros: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        lows = np.zeros((n * low + 63) // 64 + 1, np.uint64)
        if low:
            x, at = v & np.uint64((1 << low) - 1), np.arange(n, dtype=np.int64) * low
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(lows, word, x << shift)
            over = shift + np.uint64(low) > 64
            np.bitwise_or.at(lows, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
        high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) + 2 if n else 1) // 64 + 1, np.uint64)
        np.bitwise_or.at(bits, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        return cls(n, low, lows, bits, ranks)

    def save(self, path: str) -> None:
        save(f"{path}.meta.npy", np.array([self.n, self.low]))
        for k in ("lows", "bits", "ranks"):
            save(f"{path}.{k}.npy", getattr(self, k))

    @classmethod
    def load(cls, path: str) -> EliasFano:
        n, low = load(f"{path}.meta.npy").tolist()
        return cls(n, low, *(load(f"{path}.{k}.npy") for k in ("lows", "bits", "ranks")))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        x = self.lows[word] >> shift
        over = shift + np.uint64(self.low) > 64
        x[over] |= self.lows[word[over] + 1] << (np.uint64(64) - shift[over])
        return x & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        word = np.searchsorted(self.ranks, i, side="right") - 1
        place = word * 64 + _select_in_word(self.bits[word], i - self.ranks[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low)) | self._lows(i)

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th and the next number: mostly the next bit of the same word."""
        word = np.searchsorted(self.ranks, i, side="right") - 1
        bits = self.bits[word]
        at = _select_in_word(bits, i - self.ranks[word])
        rest = bits & _above(at)
        place = word * 64 + at
        following = word * 64 + _next_bit(rest)
        low = np.uint64(self.low)
        first = ((place - i).astype(np.uint64) << low) | self._lows(i)
        then = ((following - i - 1).astype(np.uint64) << low) | self._lows(i + 1)
        far = np.flatnonzero(rest == 0)
        if len(far):
            then[far] = self.access(i[far] + 1)
        return first.astype(np.int64), then.astype(np.int64)

    def _word_of_zero(self, h: np.ndarray) -> np.ndarray:
        """The word that holds the h-th zero: zeros before a word are its bits less the ones before it. Those of each _STEP-th word are kept in memory."""
        if self.zeros is None:
            at = np.arange(0, len(self.bits), _STEP)
            self.zeros = at * 64 - self.ranks[at]
        lo = (np.searchsorted(self.zeros, h, side="right") - 1) * _STEP
        hi = np.minimum(lo + _STEP, len(self.bits)) - 1
        for _ in range(_STEP.bit_length() - 1):
            mid = (lo + hi + 1) >> 1
            up = mid * 64 - self.ranks[mid] <= h
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid - 1)
        return lo

    def _run(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the numbers with a high part: from the zero before to the zero after them."""
        a, b = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        past = high > len(self.bits) * 64 - int(self.ranks[-1]) - 1
        a[past], b[past] = self.n, self.n
        live = np.flatnonzero(~past)
        h = high[live]
        word = self._word_of_zero(np.maximum(h - 1, 0))
        zeros = ~self.bits[word]
        at = _select_in_word(zeros, np.maximum(h - 1, 0) - (word * 64 - self.ranks[word]))
        begin = np.where(h > 0, word * 64 + at + 1, 0)
        rest = np.where(h > 0, zeros & _above(at), zeros)
        end = word * 64 + _next_bit(rest)
        far = np.flatnonzero(rest == 0)
        if len(far):
            w = self._word_of_zero(h[far])
            end[far] = w * 64 + _select_in_word(~self.bits[w], h[far] - (w * 64 - self.ranks[w]))
        a[live], b[live] = begin - h, end - h
        return a, b

    def _search(self, x: np.ndarray, lo: np.ndarray | int, hi: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Successors from lo on and below hi, the ends of the runs that were searched, and the low parts sought."""
        high, small = (x >> np.uint64(self.low)).astype(np.int64), x & np.uint64((1 << self.low) - 1)
        a, b = self._run(high)
        a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        end = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._lows(mid) < small[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        return a, end, small

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """The first place from lo on, and below hi, whose number is at least x; hi where there is none."""
        return self._search(x.astype(np.uint64), lo, self.n if hi is None else hi)[0]

    def find(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None, few: int = 4) -> np.ndarray:
        """The place of x from lo on and below hi, or -1. Ranges of at most `few` numbers are read one by one, wider ones by successor search."""
        out = np.full(len(x), -1)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        lo, hi = np.broadcast_to(lo, x.shape), np.broadcast_to(self.n if hi is None else hi, x.shape)
        wide = np.flatnonzero(hi - lo > few)
        if len(wide):
            at, end, small = self._search(x[wide], lo[wide], hi[wide])
            inside = np.flatnonzero(at < end)  # the high parts are equal there
            same = inside[self._lows(at[inside]) == small[inside]]
            out[wide[same]] = at[same]
        live, step = np.flatnonzero((hi > lo) & (hi - lo <= few)), 0
        while len(live):
            at = lo[live] + step
            value = self.access(at)
            same = value == x[live]
            out[live[same]] = at[same]
            step += 1
            live = live[(value < x[live]) & (at + 1 < hi[live])]
        return out
