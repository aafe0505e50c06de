"""Byte-level BPE encoding and decoding by higher-order functions over distinct words.

Words are the matches of the split pattern. A column expression folds the ranked merges over the byte
array of a distinct word, with the ranks of all mergeable pairs in a literal table, and decodes by
concatenating each id's binary piece. First the `common` most frequent words of a sample are merged once
for all: a dictionary of bounded size, which saves work and decides nothing. Then texts are cut into
blocks of whole documents. In a block, the distinct words are numbered, the documents become sequences of
those numbers, the words that are not in the dictionary are merged, and the ids of all are put in the
documents' order. Texts are not shuffled, and memory follows the block.

The literal table maps a pair of ids to its rank by displacement hashing (slot: key mod slots, moved by
what its bucket, key mod buckets, says), so that a lookup is two array accesses, not a scan of a map.

The fold takes time by the square of a word's length; words of more than `longest` bytes are merged by
the same ranks in a linked list with a heap, whole and to the same ids.

Defined cases: null text counts as empty and has no ids; null and repeated doc_ids are kept as they are;
columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import text as T
from corvid.llm.scratch import bounded_batches, short_plans, stage, tidy_driver

#: Bytes of text in a block, at least one document, and of an Arrow batch: two workers and the JVM hold some of each for every task.
BLOCK_BYTES, BATCH = 512 << 10, "2m"
#: Base of the hash by which words are looked up.
_BASE = 0x9E3779B97F4A7C15
#: The rank of pairs that do not merge; and an entry that no first id matches.
_NONE, _FREE = 65535, 1 << 49


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank by token from lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def mergeable(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank by the ids of a pair, for every split of a token into two tokens."""
    found = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                found[a, b] = rank
    return found


def displacement_table(pairs: dict[tuple[int, int], int], buckets: int = 65521) -> tuple[np.ndarray, np.ndarray]:
    """(displacement by bucket, table): the table has key * 65536 + rank, or _FREE; key: first id * 65536 + second id."""
    slots = next(p for p in (65537, 131101, 196613, 262147, 393241, 524309, 1048583, 2097169) if p > 1.25 * len(pairs))
    keys = np.array([a * 65536 + b for a, b in pairs], np.int64)
    values = keys * 65536 + np.array(list(pairs.values()), np.int64)
    order = np.argsort(keys % buckets, kind="stable")
    bounds = np.searchsorted((keys % buckets)[order], np.arange(buckets + 1))
    table, shift = np.full(slots, _FREE, np.int64), np.zeros(buckets, np.int64)
    taken, rng = bytearray(slots), np.random.default_rng(1)
    for bucket in np.argsort(-np.diff(bounds), kind="stable").tolist():
        own = order[bounds[bucket] : bounds[bucket + 1]]
        if not len(own):
            break
        base = (keys[own] % slots).tolist()
        places = None
        while places is None or any(taken[p] for p in places):
            d = int(rng.integers(slots))
            places = [(x + d) % slots for x in base]
        for p in places:
            taken[p] = 1
        shift[bucket], table[places] = d, values[own]
    return shift, table


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    ranks = load_ranks(path)
    if max(ranks.values()) >= _NONE:
        raise ValueError("ids must be below 65535")
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    pairs, first = mergeable(ranks), [ranks[bytes([b])] for b in range(256)]
    alone = [_NONE << 16 | i for i in first]
    two = [pairs.get((a, b), _NONE) << 16 | a for a in first for b in first]
    return tokens, alone, two, *displacement_table(pairs)


@lru_cache(maxsize=4)
def _pairs(path: str) -> tuple[list[int], dict[tuple[int, int], int]]:
    ranks = load_ranks(path)
    return [ranks[bytes([b])] for b in range(256)], mergeable(ranks)


def _literal(values, kind: str) -> Column:
    """An array literal: the optimiser folds the split and the cast into one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def merge_expression(path: str):
    """A function from an array of byte values to the array of ids of that word.

    The fold's state has one number per token: the rank of its pair with the next token * 65536 + its id.
    The least number is the next merge, and the leftmost of equal ones comes first.
    """
    _, alone, two, shift, table = _tables(path)
    alone_c, two_c = _literal(alone, "bigint"), _literal(two, "bigint")
    shift_c, table_c = _literal(shift.tolist(), "int"), _literal(table.tolist(), "bigint")
    low = F.lit(65535).cast("bigint")

    slots, buckets = F.lit(len(table)).cast("bigint"), F.lit(len(shift)).cast("bigint")

    def entry(key: Column) -> Column:
        """key: id * 65536 + next id. A table entry of another key exceeds every rank after the xor."""
        slot = (key % slots + F.get(shift_c, (key % buckets).cast("int"))) % slots
        rank = F.least(F.get(table_c, slot.cast("int")).bitwiseXOR(F.shiftleft(key, 16)), low)
        return F.shiftleft(rank, 16).bitwiseOR(F.shiftright(key, 16))

    def step(s: Column, _: Column) -> Column:
        def at(p: Column) -> Column:
            """p: the place, from 1, of the pair to merge. The entries of the token before and of the merged one are new, that of the second token goes."""
            merged = F.shiftright(F.get(s, p - 1), 16)
            own = F.shiftleft(merged, 16).bitwiseOR(F.get(s, p + 1).bitwiseAND(low))
            new = lambda e, i: F.get(F.transform(F.array(F.when(i == p - 1, own).otherwise(F.shiftleft(e.bitwiseAND(low), 16).bitwiseOR(merged))), entry), F.lit(0))
            return F.array_remove(F.transform(s, lambda e, i: F.when((i < p - 2) | (i > p), e).when(i == p, gone).otherwise(new(e, i))), gone)

        least = F.array_min(s)
        return F.when(least >= stop, s).otherwise(F.get(F.transform(F.array(F.array_position(s, least).cast("int")), at), F.lit(0)))

    # Both ends are an id that no pair has.
    edge = F.array(F.lit(_NONE << 16 | 65535).cast("bigint"))
    stop, gone = F.lit(_NONE << 16).cast("bigint"), F.lit(-1).cast("bigint")

    def merge(word: Column) -> Column:
        start = F.transform(word, lambda b, i: F.coalesce(F.get(two_c, b * 256 + F.get(word, i + 1)), F.get(alone_c, b)))
        own = lambda s: F.filter(F.transform(s, lambda e: e.bitwiseAND(low).cast("int")), lambda i: i < 65535)
        return F.aggregate(word, F.concat(edge, start, edge), step, own)

    return merge


def merge_long(word: bytes, path: str) -> list[int]:
    """The ids of one word by the same rule, in time by its length: a linked list of tokens and a heap of its pairs."""
    first, pairs = _pairs(path)
    ids = [first[b] for b in word]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids[:-1], ids[1:], strict=True)) if (r := pairs.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or ids[i] != a or ids[j] != b:
            continue  # one of both has been merged since
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (r := pairs.get((ids[left], ids[right]))) is not None:
                heapq.heappush(heap, (r, left, ids[left], ids[right]))
    return [x for x in ids if x >= 0]


def piece_expression(path: str):
    """A function from an array of ids to the bytes they stand for."""
    pieces = F.split(F.lit(",".join(t.hex() for t in _tables(path)[0])), ",")
    return lambda ids: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def _hashes(words: pa.Array, step: int = 8192) -> np.ndarray:
    """64-bit hash of each word; a few at a time, as each byte takes some 40 for a while."""
    out = np.empty(len(words), np.uint64)
    for at in range(0, len(words), step):
        data, offsets = T.buffers(words.slice(at, step))
        out[at : at + step] = T.segments(data.astype(np.uint64), offsets[:-1], np.diff(offsets), _BASE)
    return out


@dataclass
class _Dictionary:
    """Words, looked up by hashes that a comparison confirms.

    As arrays, since a dict of the words would take some 50 MB of each worker, idle ones too; and sorted
    once, since Arrow's lookup hashes all words anew for each piece. A word whose hash another has may
    not be found; it is merged like others then.
    """

    words: pa.Array
    hashes: np.ndarray
    order: np.ndarray
    longest: int

    @classmethod
    def of(cls, words: pa.Array) -> _Dictionary:
        hashes = _hashes(words)
        order = np.argsort(hashes).astype(np.int32)
        return cls(words, hashes[order], order, pc.max(pc.binary_length(words)).as_py() or 0)

    def __len__(self) -> int:
        return len(self.words)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Places among the words of the dictionary, or -1."""
        out = np.full(len(words), -1, np.int32)
        few = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) <= self.longest) if len(self) else out[:0]
        if len(few):
            words = words.take(pa.array(few))
            at = self.order[np.minimum(np.searchsorted(self.hashes, _hashes(words)), len(self) - 1)]
            same = pc.equal(words, self.words.take(pa.array(at))).to_numpy(zero_copy_only=False)
            out[few[same]] = at[same]
        return out


class _Block:
    """The numbered distinct words of a block, after those of the dictionary, and its documents as sequences of their numbers.

    A text is cut before each run of ASCII white space first: the pattern's matches do not cross such a
    cut where white space of other kinds is absent, so that every distinct unit is matched once. Texts
    with white space of other kinds are matched whole.
    """

    _OTHER = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

    def __init__(self, split, common: _Dictionary):
        self.split, self.common = split, common
        self.number: dict[str, int] = {}
        self.docs: list[pa.Array] = []
        self.places: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, docs: pa.Array, texts: pa.Array) -> None:
        odd = pc.match_substring_regex(texts, self._OTHER).to_numpy(zero_copy_only=False)
        data, offsets = T.buffers(texts)
        space = T._SPACE[data]
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        if odd.any():
            start &= ~np.repeat(odd, np.diff(offsets))
            start[offsets[:-1][odd]] = True
        at = np.flatnonzero(start)
        coded = T.binary_array(data, np.append(at, len(data)) if len(at) else np.zeros(1)).dictionary_encode()
        number, base = self.number, len(self.common)
        # Words of the dictionary are their own only match.
        units = coded.dictionary.cast(self.common.words.type)
        own = self.common.numbers(units)
        new = np.flatnonzero(own < 0)
        matches = [self.split(u) for u in units.take(pa.array(new)).to_pylist()]
        matched = pa.array([x for m in matches for x in m], units.type).dictionary_encode()
        numbers = self.common.numbers(matched.dictionary)
        rest = np.flatnonzero(numbers < 0)
        numbers[rest] = [number.setdefault(x, base + len(number)) for x in matched.dictionary.take(pa.array(rest)).to_pylist()]
        sizes = np.ones(len(units), np.int64)
        sizes[new] = [len(m) for m in matches]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(int(starts[-1]), np.int32)
        flat[starts[:-1][own >= 0]] = own[own >= 0]
        flat[T.ragged(starts, new)[0]] = numbers[matched.indices.to_numpy()]
        places, ends = T.ragged(starts, coded.indices.to_numpy())
        self.docs.append(docs)
        self.places.append(flat[places].astype("<i4"))
        self.counts.append(np.diff(ends[np.searchsorted(at, offsets)]))
        self.bytes += len(data)


def _joined(ids: pa.Array, decoded: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of ids, ids and bytes of each document, from those of its words in order."""
    raw, n = T.buffers(ids)
    text, m = T.buffers(decoded)
    return pa.array(np.diff(n[bounds]) // 4), T.binary_array(raw, n[bounds]), T.binary_array(text, m[bounds])


def _bytes_of(word: Column) -> Column:
    """Byte values of a word given as text: each byte is one character of ISO 8859-1."""
    return F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c))


def common_words(docs: DataFrame, ranks: str, pattern: str, common: int, sample_rows: int, longest: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """At most `common` words, the most frequent ones of about sample_rows rows, their ids (32-bit little-endian) and the bytes of these."""
    rows = docs.count() if common else 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for batch in batches:
            for x in T.pieces(batch):
                found: Counter[str] = Counter()
                for text in T.column(x, "text").to_pylist():
                    found.update(split(text or ""))
                short = [(w, c) for w, c in found.items() if len(w) <= longest // 4 and split(w) == [w]]
                if short:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in short]), pa.array([c for _, c in short])], ["word", "c"])

    if not common:
        return pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.binary())
    sample = docs.select("text") if rows <= sample_rows else docs.select("text").sample(sample_rows / rows, 1)
    counted = sample.mapInArrow(T.released(count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 1")
    # Written before they are merged: a plan that holds the literal tables is described anew at each of its shuffles.
    most = stage(counted.orderBy(F.desc("c"), "word").limit(common).select("word").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"), "words")
    ids = most.select("word", merge_expression(ranks)(_bytes_of(F.col("word"))).alias("ids"))
    found = ids.select("word", "ids", piece_expression(ranks)(F.col("ids")).alias("piece")).toArrow().combine_chunks()
    off, flat = T.lists(_whole(found.column("ids")))
    tidy_driver(docs.sparkSession)
    return _whole(found.column("word")), T.binary_array(flat.to_numpy().astype("<u4").view(np.uint8), off * 4), _whole(found.column("piece"))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def encode(docs: DataFrame, ranks: str, pattern: str, block_bytes: int = BLOCK_BYTES, longest: int = 96, common: int = 300_000, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, n_tokens, ids (32-bit little-endian) and decoded (bytes) of every document.

    ranks: a rank file's path on every machine; pattern: the split pattern of its tokeniser; common and
    sample_rows bound the dictionary, none at common 0.
    """
    bounded_batches(docs.sparkSession, BATCH)
    short_plans(docs.sparkSession)
    tidy_driver(docs.sparkSession)
    often, *coded_ = common_words(docs, ranks, pattern, common, sample_rows, longest)
    dictionary, pieces_of = docs.sparkSession.sparkContext.broadcast(_Dictionary.of(often)), docs.sparkSession.sparkContext.broadcast(coded_)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = regex.compile(pattern).findall, dictionary.value
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)

        def row(block: _Block) -> pa.RecordBatch:
            found, places, extra = [x.encode() for x in block.number], np.concatenate(block.places), []
            long = np.array([len(w) > longest for w in found], bool)
            short = [w for w in found if len(w) <= longest]
            if long.any():
                to = np.where(long, len(short) + np.cumsum(long) - 1, np.cumsum(~long) - 1) + len(known)
                places, extra = np.concatenate([np.arange(len(known)), to])[places].astype("<i4"), [merge_long(w, ranks) for w in found if len(w) > longest]
            lengths = np.concatenate([[0], np.cumsum([len(w) for w in short])])
            arrays = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.frombuffer(b"".join(short), np.uint8).astype(np.int32)))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(block.counts))]).astype("<i8")
            return pa.RecordBatch.from_arrays(
                [one(pa.concat_arrays(block.docs)), pa.array([ends.tobytes()], pa.binary()), pa.array([places.tobytes()], pa.binary()), one(arrays), one(pa.array(extra, pa.list_(pa.int32())))],
                ["docs", "ends", "places", "words", "extra"],
            )

        block = _Block(split, known)
        for batch in batches:
            for x in T.pieces(batch, most=block_bytes):
                block.add(T.column(x, "doc_id"), pc.fill_null(T.column(x, "text"), ""))
                if block.bytes >= block_bytes:
                    yield row(block)
                    block = _Block(split, known)
        if block.docs:
            yield row(block)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = pieces_of.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                docs_, ids, decoded = (T.column(row, c).flatten() for c in ("docs", "ids", "decoded"))
                ends, places = (np.frombuffer(T.column(row, c)[0].as_buffer(), t) for c, t in (("ends", "<i8"), ("places", "<i4")))
                off, flat = T.lists(ids)
                coded = pa.concat_arrays([known, T.binary_array(flat.to_numpy().astype("<u4").view(np.uint8), off * 4)])
                bytes_ = pa.concat_arrays([pieces, decoded])
                step, at = max(1, len(docs_) * T.PIECE_BYTES // max(1, 8 * len(places))), 0
                while at < len(docs_):
                    to = min(len(docs_), at + step)
                    own, bounds = pa.array(places[ends[at] : ends[to]]), ends[at : to + 1] - ends[at]
                    yield pa.RecordBatch.from_arrays(
                        [docs_.slice(at, to - at), *_joined(coded.take(own), bytes_.take(own), bounds)],
                        ["doc_id", "n_tokens", "ids", "decoded"],
                    )
                    at = to

    merge, piece = merge_expression(ranks), piece_expression(ranks)
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.released(words), "docs array<long>, ends binary, places binary, words array<array<int>>, extra array<array<int>>")
    merged = blocks.select("docs", "ends", "places", F.concat(F.transform("words", merge), "extra").alias("ids"))
    pieced = merged.select("docs", "ends", "places", "ids", F.transform("ids", piece).alias("decoded"))
    return pieced.mapInArrow(T.released(assemble), "doc_id long, n_tokens long, ids binary, decoded binary")
