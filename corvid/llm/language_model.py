"""A word n-gram model (of order 3, or 2) in an Elias-Fano trie, trained and queried in shards.

Tokens are words with A-Z lower-cased, then one end token per text; an end stands before the first word.
Level 1 has the sorted hashes of all training words, their counts and quantised backoff weights; a word's
id is its rank. Level 2 has, per word, the ids of the words seen after it at least `least` times, and
level 3 the same per entry of level 2: a monotone pointer per context into one monotone sequence, in which
a context's ids are relative to its place, so that a lookup is a successor search within its range. Levels have absolute-discounted shares and the weight of the level below, each quantised to steps
of 2**-12 in log10: a probability is the share, 0 where the level has none, plus the context's weight times
the probability one level below, down to the add-one unigram, so that each context's sum to 1. A text's
first token has the end before it as its whole context and stays at level 2.

Counts come from partial counts per piece of text, combined per piece. Level 1 is cut by ranges of the
hash, the others by a hash of the pair, so that a frequent word's pairs are in all shards and no frequent
word loads one task (those that follow one pair are at most the vocabulary). Pieces send each shard one
packed block of sorted, counted rows; a shard is merged from its blocks and written once. Levels are files
in the shared folder, mapped into memory by the tasks that score, not sent to them. Shards grow in number
with the session's shuffle partitions.

Defined cases: null or empty text is the end token alone; without training texts every token has the
probability 1; rows that repeat count each; null doc_ids count as empty text in the split; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import text as T
from corvid.llm.elias_fano import EliasFano, load, save
from corvid.llm.scratch import bounded_batches, fresh_dir

#: The end token: no word holds a space.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
#: Steps of one unit of log10.
SCALE = 4096
_PIECE = T.PIECE_BYTES
#: Bytes of text scored at once: what a worker holds for each byte is some 40.
_SCORED = T.PIECE_BYTES // 2
#: The context of rows that only name a shard.
_NONE = -(1 << 40)


def _hashes(w: T.Words) -> np.ndarray:
    """Hashes of the distinct words, the end token last."""
    return np.array([*map(xxhash.xxh3_64_intdigest, w.bytes_of()), int(END)], np.uint64)


@dataclass
class _Stream:
    """A piece as numbers of distinct tokens: all texts' tokens with their ends, contexts, texts' numbers."""

    hashes: np.ndarray
    tokens: np.ndarray
    contexts: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> _Stream:
        w = T.words(texts, lower=True)
        n, hashes = len(w), _hashes(w)
        end = len(hashes) - 1
        tokens = np.full(len(w.ids) + n, end, np.int32)
        last = w.bounds[1:] + np.arange(n)
        words = np.ones(len(tokens), bool)
        words[last] = False
        tokens[words] = w.ids
        contexts = np.full(len(tokens), end, np.int32)
        contexts[1:] = tokens[:-1]
        return cls(hashes, tokens, contexts, np.repeat(np.arange(n, dtype=np.int32), np.diff(w.bounds) + 1))


@dataclass(frozen=True)
class Model:
    """Where the levels are. bits: log2 of level 1's shards; bases: first id of each of them; shards: number of pair shards; levels: per level from 2 on, the shards that have rows."""

    path: str
    bits: int
    bases: tuple[int, ...]
    tokens: int
    shards: int = 1
    levels: tuple[tuple[int, ...], ...] = ()

    @property
    def words(self) -> int:
        return self.bases[-1]


@lru_cache(maxsize=4096)
def _level1(path: str, shard: int) -> tuple[EliasFano, np.ndarray]:
    return EliasFano.load(f"{path}/words-{shard:05d}"), load(f"{path}/counts-{shard:05d}.npy")


@lru_cache(maxsize=4096)
def _backoff(path: str, shard: int) -> np.ndarray:
    return load(f"{path}/backoff-{shard:05d}.npy")


@lru_cache(maxsize=4096)
def _level(path: str, level: int, shard: int) -> tuple[EliasFano | None, EliasFano, EliasFano]:
    p = f"{path}/level{level}-{shard:05d}"
    return EliasFano.load(f"{p}.contexts") if level == 2 else None, EliasFano.load(f"{p}.pointers"), EliasFano.load(f"{p}.ids")


@lru_cache(maxsize=4096)
def _column(path: str, level: int, shard: int, name: str) -> np.ndarray:
    return load(f"{path}/level{level}-{shard:05d}.{name}.npy")


def _each(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and the places of its rows."""
    order = np.argsort(shards, kind="stable")
    bounds = [*np.flatnonzero(np.diff(shards[order], prepend=-1)).tolist(), len(order)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(shards[order[a]]), order[a:b]


def word_ids(m: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id or -1, count) of words by hash."""
    ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
    for shard, rows in _each(_shard(hashes, m.bits)):
        if m.bases[shard] == m.bases[shard + 1]:
            continue
        words, have = _level1(m.path, shard)
        at = words.find(hashes[rows])
        known = at >= 0
        ids[rows[known]], counts[rows[known]] = m.bases[shard] + at[known], have[at[known]]
    return ids, counts


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _by_id(m: Model, ids: np.ndarray, read) -> np.ndarray:
    out = np.zeros(len(ids), np.int64)
    for shard, rows in _each(np.searchsorted(m.bases, ids, side="right") - 1):
        out[rows] = read(m.path, shard)[ids[rows] - m.bases[shard]]
    return out


def _counts(path: str, shard: int) -> np.ndarray:
    return _level1(path, shard)[1]


def find(m: Model, context: np.ndarray, word: np.ndarray, after: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Codes of pairs (context, word) and the backoff codes of those, -1 where the model has none.

    after: places of pairs among the given ones and the words that follow them; then the codes of these triples come third.
    """
    pair, back = np.full(len(word), -1), np.full(len(word), -1)
    triple = np.full(len(after[0]) if after else 0, -1)
    two, three = (set(m.levels[i]) if len(m.levels) > i else set() for i in (0, 1))
    if not two or not len(word):
        return pair, back, triple
    if after:
        order = np.argsort(after[0], kind="stable")
        first, last = np.searchsorted(after[0][order], [np.arange(len(word)), np.arange(1, len(word) + 1)])
    for shard, rows in _each(_pair_shard(_joined(context, word), m.shards)):
        if shard not in two:
            continue
        contexts, pointers, ids = _level(m.path, 2, shard)
        own = context[rows]
        new = np.append(True, own[1:] != own[:-1])  # pairs in order look their context up once
        place = contexts.find(own[new])
        lo, hi = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        lo[place >= 0], hi[place >= 0] = pointers.ranges(place[place >= 0])
        of = np.cumsum(new) - 1
        at = ids.find(place[of] * (m.words + 1) + word[rows], lo[of], hi[of])
        rows, at = rows[at >= 0], at[at >= 0]
        pair[rows] = _column(m.path, 2, shard, "codes")[at]
        if len(m.levels) > 1:
            back[rows] = _column(m.path, 2, shard, "backoff")[at]
        if after and shard in three:
            asked, _ = T.ragged(np.append(first, last[-1:]), rows)
            asked, at = order[asked], np.repeat(at, last[rows] - first[rows])
            _, pointers, ids = _level(m.path, 3, shard)
            place = ids.find(at * (m.words + 1) + after[1][asked], *pointers.ranges(at))
            triple[asked[place >= 0]] = _column(m.path, 3, shard, "codes")[place[place >= 0]]
    return pair, back, triple


def _save_level(path: str, level: int, shard: int, words: int, pointers: np.ndarray, word: np.ndarray, contexts: np.ndarray | None = None, **columns: np.ndarray) -> None:
    """One shard: the words of context i are those from pointers[i] on; each follows i * (words + 1), so that all are one monotone sequence."""
    name = f"{path}/level{level}-{shard:05d}"
    if contexts is not None:
        EliasFano.build(contexts).save(f"{name}.contexts")
    EliasFano.build(pointers).save(f"{name}.pointers")
    EliasFano.build(word + np.repeat(np.arange(len(pointers) - 1), np.diff(pointers)) * (words + 1)).save(f"{name}.ids")
    for k, v in columns.items():
        save(f"{name}.{k}.npy", v)


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * SCALE), 0, 65535).astype(np.uint16)


def _unquantised(codes: np.ndarray, none: float) -> np.ndarray:
    return np.where(codes < 0, none, 10.0 ** (-codes / SCALE))


def train(docs: DataFrame, path: str | None = None, least: int = 1, discount: float = 0.75, order: int = 3) -> Model:
    """Counts and writes the levels from the texts of docs.

    least: pairs and triples seen less often are left out, none at 1 (the exact form); order: 3, or 2 without triples.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "language-model")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, n.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in T.pieces(batch, most=_PIECE):
                s = _Stream.of(T.column(x, "text"))
                have = np.bincount(s.tokens, minlength=len(s.hashes))
                h = s.hashes[have > 0]
                yield pa.RecordBatch.from_arrays([pa.array(_shard(h, bits)), pa.array(h.view(np.int64)), pa.array(have[have > 0])], ["shard", "hash", "c"])

    def write_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        h, at = np.unique(table.column("hash").to_numpy().view(np.uint64), return_inverse=True)
        c = np.zeros(len(h), np.int64)
        np.add.at(c, at, table.column("c").to_numpy())
        EliasFano.build(h).save(f"{path}/words-{shard:05d}")
        save(f"{path}/counts-{shard:05d}.npy", c)
        return pa.table({"shard": [shard], "words": [len(h)], "tokens": [int(c.sum())]})

    texts = docs.select("text")
    parts = texts.mapInArrow(count, "shard long, hash long, c long")
    rows = {r.shard: r for r in parts.groupBy("shard").applyInArrow(write_words, "shard long, words long, tokens long").collect()}  # one row per shard
    bases = np.concatenate([[0], np.cumsum([rows[i].words if i in rows else 0 for i in range(1 << bits)])])
    model = Model(path, bits, tuple(bases.tolist()), sum(r.tokens for r in rows.values()))

    if model.words >= 1 << 31:
        raise ValueError("word ids must fit in 31 bits")
    shards = max(1, n)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per piece and shard of the pair: counted pairs with the word that follows in the text, packed."""
        for batch in batches:
            for x in T.pieces(batch, most=_PIECE):
                s = _Stream.of(T.column(x, "text"))
                ids, counts = word_ids(model, s.hashes)
                size, often = len(ids), counts >= least  # a pair is no more frequent than its words
                keep = often[s.tokens] & often[s.contexts]
                follows = np.full(len(s.tokens), -1, np.int32)
                if order > 2 and len(follows):
                    follows[:-1] = np.where((s.tokens[:-1] != size - 1) & often[s.tokens[1:]], s.tokens[1:], -1)
                by = np.argsort(ids, kind="stable")  # local numbers in the order of ids: one sort orders all
                rank = np.empty(size + 1, np.int64)
                rank[by], rank[size] = np.arange(1, size + 1), 0
                local = [rank[x[keep]] for x in (s.contexts, s.tokens, follows)]
                key, follow, c = _counted(*local, size + 1)
                of = np.append(-1, ids[by])
                key, follow = _joined(of[key // (size + 1)], of[key % (size + 1)]), of[follow]
                at = _pair_shard(key, shards).astype(np.uint32 if shards > 65535 else np.uint16)
                order_ = np.argsort(at, kind="stable")
                bounds = np.searchsorted(at[order_], np.arange(shards + 1, dtype=np.int64))
                out = [(i, _packed(key[r], follow[r], c[r])) for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if hi > lo for r in (order_[lo:hi],)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], ["shard", "grams"])

    def write(table: pa.Table) -> pa.Table:
        """One shard of levels 2 and 3, with the mass that each context word has in it."""
        shard = table.column("shard")[0].as_py()
        key, follow, c = _merged(table.column("grams"), model.words + 2)
        start = np.flatnonzero(np.diff(key, prepend=-1))
        pairs, total = key[start], np.add.reduceat(c, start)
        kept = total >= least
        three = (follow >= 0) & (c >= least)
        sums = np.add.reduceat(np.where(three, c - discount, 0.0), start)[kept]
        three &= np.repeat(kept, np.diff(np.append(start, len(key))))
        pairs, total = pairs[kept], total[kept]
        context, word = pairs >> 32, pairs & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(context, prepend=-1))
        if len(pairs):
            columns = {"codes": _quantised((total - discount) / _by_id(model, context, _counts))}
            if order > 2:
                columns |= {"backoff": _quantised(1 - sums / total)}
            _save_level(path, 2, shard, model.words, np.append(first, len(pairs)), word, context[first], **columns)
        if order > 2 and three.any():
            ends = np.append(np.searchsorted(key[three], pairs), int(three.sum()))
            _save_level(path, 3, shard, model.words, ends, follow[three], codes=_quantised((c[three] - discount) / np.repeat(total, np.diff(ends))))
        masses = np.add.reduceat(total - discount, first) if len(first) else np.zeros(0)
        # The last row says that the shard has rows, and whether triples.
        return pa.table({"context": np.append(context[first], -shard - 1), "mass": np.append(masses, float(three.any()))})

    written = texts.mapInArrow(T.released(grams), "shard long, grams binary").groupBy("shard").applyInArrow(T.released_table(write), "context long, mass double")
    mass = written.groupBy("context").agg(F.sum("mass").alias("mass")).withColumn("shard", F.when(F.col("context") < 0, F.lit(min(rows, default=0)).cast("long")).otherwise(_range_shards(model, F.col("context"))))

    def write_backoff(table: pa.Table) -> pa.Table:
        shard, context, mass = table.column("shard")[0].as_py(), table.column("context").to_numpy(), table.column("mass").to_numpy()
        counts, own = _counts(path, shard), context >= 0
        at = context[own] - model.bases[shard]
        share = np.zeros(len(counts))
        share[at] = mass[own] / counts[at]
        save(f"{path}/backoff-{shard:05d}.npy", _quantised(1 - share))
        said = (context < 0) & (context > _NONE)
        return pa.table({"shard": -context[said] - 1, "triples": mass[said] > 0})

    every = spark.createDataFrame([(i, _NONE, 0.0) for i in rows], "shard long, context long, mass double").unionByName(mass.select("shard", "context", "mass"))
    made = every.groupBy("shard").applyInArrow(write_backoff, "shard long, triples boolean").collect()  # one row per shard
    levels = (tuple(sorted(r.shard for r in made)), tuple(sorted(r.shard for r in made if r.triples)))
    return replace(model, shards=shards, levels=levels[: order - 1])


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context << 32) | word


def _pair_shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (T.mix(key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them; key is not kept."""
    by = np.argsort(key)
    key[:] = key[by]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.empty(len(key), np.int32)
    at[by] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], at


def _counted(context: np.ndarray, word: np.ndarray, follow: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context * size + word, follow) in order, and how often each is given; all numbers are below size."""
    pair, back = context * size + word, None
    if size >= 1 << 20:  # its cube would not fit
        back, pair = np.unique(pair, return_inverse=True)
    code, c = np.unique(pair * size + follow, return_counts=True)
    return code // size if back is None else back[code // size], code % size, c


def _packed(key: np.ndarray, follow: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted rows: steps of the key, the words that follow and the counts, compressed column by column."""
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in (np.diff(key, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T, follow.astype("<i4").view(np.uint8).reshape(-1, 4).T, c.astype("<u4").view(np.uint8).reshape(-1, 4).T))
    return len(key).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], 16 * n, "zstd"), np.uint8)
    part = lambda at, width, kind: np.ascontiguousarray(raw[at * n : (at + width) * n].reshape(width, n).T).view(kind)[:, 0].astype(np.int64)
    return np.cumsum(part(0, 8, "<i8")), part(8, 4, "<i4"), part(12, 4, "<u4")


def _merged(packed: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, follow) of all pieces, in order, with their sums; size: more than the numbers that may follow."""
    parts = [_unpacked(x.as_py()) for x in packed]
    key, follow, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
    del parts
    pairs, rank = np.unique(key, return_inverse=True)
    code = rank * size + follow + 1
    by = np.argsort(code)
    code = code[by]
    start = np.flatnonzero(np.diff(code, prepend=-1))
    return pairs[code[start] // size], code[start] % size - 1, np.add.reduceat(c[by], start)


def _range_shards(m: Model, id_: Column) -> Column:
    """Level 1's shard of an id: the number of shard bases at or below it, less one."""
    return (F.size(F.filter(F.array(*[F.lit(b) for b in m.bases[:-1]]), lambda b: b <= id_)) - 1).cast("long")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score, in log10, of every document."""
    total = model.tokens + model.words + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in T.pieces(batch, most=_SCORED):
                s = _Stream.of(T.column(x, "text"))
                n = x.num_rows
                ids, counts = word_ids(model, s.hashes)
                share = (counts + 1) / total
                context, token = s.contexts, s.tokens
                weight = np.ones(len(ids))
                known = ids >= 0
                weight[known] = 10.0 ** (-_by_id(model, ids[known], _backoff) / SCALE)
                each = weight[context]
                each *= share[token]
                both = known[context] & known[token]
                key = ids[context[both]]
                key <<= 32
                key |= ids[token[both]]
                pairs, at = _distinct(key)
                asked = None
                if len(model.levels) > 1:
                    place = np.full(len(token), -1, np.int32)
                    place[both] = at
                    after = s.doc[1:] == s.doc[:-1]  # all but first tokens
                    seen = after & (place[:-1] >= 0) & known[token[1:]]
                    key = place[:-1][seen].astype(np.int64)
                    del place
                    key *= len(ids)
                    key += token[1:][seen]
                    two, spread = _distinct(key)
                    asked = (two // len(ids), ids[two % len(ids)])
                    del two
                del key
                code, back, triple = find(model, pairs >> 32, pairs & 0xFFFFFFFF, asked)
                each[both] += _unquantised(code, 0.0)[at]
                if asked:
                    weight = np.ones(len(token))
                    weight[both] = _unquantised(back, 1.0)[at]
                    each[1:][after] *= weight[:-1][after]
                    each[1:][seen] += _unquantised(triple, 0.0)[spread]
                each, base = np.log10(each, out=each), np.log10(share)
                per = lambda w: np.bincount(s.doc, w, n)
                yield pa.RecordBatch.from_arrays(
                    [T.column(x, "doc_id"), pa.array(np.bincount(s.doc, minlength=n)), pa.array(per(counts[token] > 0).astype(np.int64)), pa.array(np.full(n, model.tokens)), pa.array(per(base[token])), pa.array(per(each))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.released(rows), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
