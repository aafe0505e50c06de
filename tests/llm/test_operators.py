"""Each operator against a plain version on a small table with all defined cases."""

import collections
import hashlib
import math
import re
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvid.llm import byte_bpe, exact_dedup, language_model, mixing, near_dedup, quality_rules, sharding, token_records, toxicity
from corvid.llm import text as T
from corvid.llm.elias_fano import EliasFano
from corvid.llm.substring_dedup import FingerprintIndex

from .conftest import ROWS, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").encode())


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def test_words_and_pieces():
    texts = pa.array([t for _, t in ROWS])
    w = T.words(texts)
    unique = w.bytes_of()
    assert [[unique[i] for i in w.ids[a:b]] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)] == [split(t) for _, t in ROWS]
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for most in (1, 100, 1 << 20):
        assert [x for p in T.pieces(batch, most=most) for x in p.column(0).to_pylist()] == texts.to_pylist()


def brute_substring(batches, width):
    """Words left in the last batch, given all earlier ones."""
    seen = collections.Counter()
    for rows in batches:
        for _, t in rows:
            ws = split(t)
            seen.update(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))
    out = []
    for i, t in batches[-1]:
        ws = split(t)
        gone = {j for k in range(len(ws) - width + 1) if seen[tuple(ws[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((i, len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,gram", [(35, 10), (6, 2), (3, 3)])
def test_substring_dedup(spark, docs, empty, width, gram):
    got = FingerprintIndex(spark, width=width, gram=gram).deduplicate(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute_substring([ROWS], width)
    assert FingerprintIndex(spark, width=width, gram=gram).deduplicate(empty).count() == 0


def test_substring_dedup_in_batches(spark):
    batches = [[(i, prose(i, 60)) for i in range(4)], [(10, prose(2, 50)), (11, prose(20, 50))], [(20, prose(20, 45) + " " + prose(3, 60)), (21, "a b c")]]
    frames = [spark.createDataFrame(b, "doc_id long, text string") for b in batches]
    index = FingerprintIndex(spark, width=8, gram=3)
    for i, f in enumerate(frames):
        history = None if not i else frames[0] if i == 1 else frames[0].unionByName(frames[1])
        assert sorted(map(tuple, index.deduplicate(f, history).collect()), key=str) == brute_substring(batches[: i + 1], 8)
        index.compact()
        assert len(index.runs) == 1


def test_token_records(spark, docs, empty, tmp_path):
    path = P.path("word_bpe_49k.json")
    encoder = token_records.Encoder(path, 1)
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, len(ids), np.array(ids, "<u4").tobytes()))
    got = token_records.encoded(docs, path, path=f"file://{tmp_path}/records").orderBy("start").collect()
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.ids)) for r in got], key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert token_records.encoded(empty, path).count() == 0
    file = next(p for p in sorted((tmp_path / "records").glob("*.idx")) if p.stat().st_size > 16).with_suffix("")
    records = token_records.RecordFile(f"file://{file}")
    order = np.arange(len(records.index))[::-1]
    assert [x[1].tolist() for x in records.records(order)] == [x[1].tolist() for x in records.records()][::-1]


def test_token_records_added_tokens():
    """Added tokens in a text get their own ids, as a freshly loaded tokenizer gives them."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = ["hello <|endoftext|> world foo<|startoftext|>bar", "<|endoftext|><|endoftext|>", "x\n<|STARTOFTEXT|>\t<|startoftext|>", "plain"]
    ids, off = token_records.Encoder(path, 1).encode(pa.array(texts))
    fresh = Tokenizer.from_file(path)
    want = [[*fresh.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    assert 49407 in want[0] and 49406 in want[0]


def test_frames_detect_damage():
    framed = token_records.frame(b"payload") + token_records.frame(b"")
    payload, at = token_records.unframe(framed)
    assert bytes(payload) == b"payload" and token_records.unframe(framed, at)[1] == len(framed)
    for i in range(len(framed) - 16):
        bad = bytearray(framed)
        bad[i] ^= 1
        with pytest.raises((ValueError, struct.error)):
            token_records.unframe(bytes(bad))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, empty, weak):
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS]
    groups = collections.defaultdict(list)
    for (i, _), t in zip(ROWS, normal, strict=True):
        groups[t].append(i)
    want = []
    for (i, _), t in zip(ROWS, normal, strict=True):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    digest = (lambda c: F.substring(F.unhex(F.md5(c)), 1, 0)) if weak else exact_dedup.sha256  # weak: all digests collide
    got = exact_dedup.exact_duplicates(docs, digest).drop("row_hash")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(empty, digest).count() == 0


def test_exact_dedup_keeps_state(spark):
    stream = exact_dedup.StreamingDeduplicator(spark)
    for rows in ([(5, "a"), (6, "b")], [(3, "a"), (7, "c")]):
        stream.ingest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.keep_id, r.group_size) for r in stream.state().collect()) == [(3, 2), (6, 1), (7, 1)]


def test_quality_rules(docs, empty):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality_rules.report(docs).collect()}
    for i, t in ROWS:
        ws = [w.decode() for w in split(t)]
        grams = collections.Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        repeated = {j for k in range(len(ws) - 4) if grams[tuple(ws[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        r = got[i, len(ws), sum(map(len, ws))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(ws) < 10 or 100 * len(repeated) > 20 * len(ws))
        assert not (r.base_failed and r.kept)
    assert quality_rules.report(empty).count() == 0
    lazily = {(r.doc_id, r.text): r.failed_rule is None for r in quality_rules.cascade(docs).collect()}
    for r in quality_rules.report(docs).join(docs.select("doc_id", "text"), "doc_id").filter("doc_id <> 13").collect():
        assert lazily[r.doc_id, r.text] == r.kept


def test_cascade_order():
    class Fake:
        name = "x"

    order = sorted([(Fake, 2.0, 0.5), (Fake, 1.0, 0.5), (Fake, 1.0, 0.0)], key=lambda x: (-x[2] / x[1], x[1]))
    assert [x[1:] for x in order] == [(1.0, 0.5), (2.0, 0.5), (1.0, 0.0)]


def jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark, docs, empty):
    keys = [0, 1, 2, 10**6, 2**62, 2**63 - 1, -1, -(2**63), *range(100, 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100):
        got = {r.k: r.s for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}
    rows = sharding.shard_documents(docs, 4, cells=3).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS if i)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    assert sharding.shard_documents(empty, 4).count() == 0


def test_toxicity(spark, docs, empty):
    good, bad = ("group", "insult")
    rows = [(i, f"{prose(i, 12)} {good if i % 2 else prose(i + 999, 1)} {bad if i % 4 < 2 else prose(i + 777, 1)}", int(i % 4 == 1)) for i in range(800)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(d, labels, dims=1 << 14, least_z=3)
    scored = {r.doc_id: r.score for r in toxicity.score(d, machine).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.5) == bool(y) for i, _, y in out]) > 0.95  # an interaction: neither term is toxic alone
    other = toxicity.score(docs, machine).collect()
    assert len(other) == len(ROWS) and all(0 <= r.score <= 1 for r in other)
    assert toxicity.score(empty, machine).count() == 0
    none = toxicity.train(d, labels.limit(0))
    assert toxicity.without_toxic(docs, none).count() == len(ROWS)
    assert toxicity.without_toxic(docs, none).columns == docs.columns


def shared_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 7, None: 30}, {"a": 1, "b": 1000, "c": 1000}, {"x": 10}, {"a": 0, "b": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = shared_targets(sizes, (5, 2, 1), 1.5, 2)
    assert {r.source: pytest.approx(r.target) for r in mixing.targets(df).collect()} == want


def test_mix(docs, empty):
    for cells in (1, 7, 1024):
        rows = mixing.mix(docs, cells=cells).collect()
        assert len(rows) == len(ROWS)
        one = sorted((r.doc_id or -1, r.size, r.taken) for r in rows)
        assert one == sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs.repartition(5), cells=cells).collect())
        for goal in {r.target for r in rows}:
            own = [r for r in rows if r.target == goal]
            assert abs(sum(r.taken for r in own) - goal) <= max(r.size for r in own) / 2 + 1
            assert all(r.taken <= 2 * r.size for r in own)
    assert mixing.mix(empty).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for u, n in ((1 << 63, 1000), (10, 1000), (1000, 1), (5000, 700)):
        v = np.sort(rng.integers(0, u, n)).astype(np.uint64)
        e = EliasFano.build(v)
        x = np.concatenate([v, rng.integers(0, u, 500).astype(np.uint64)])
        assert (e.access(np.arange(n)) == v).all()
        assert (e.successor(x) == np.searchsorted(v, x)).all()
        assert (e.find(x) >= 0).tolist() == np.isin(x, v).tolist()
        i = rng.integers(0, max(1, n - 1), 300) if n > 1 else np.zeros(0, np.int64)
        assert all((a == b).all() for a, b in zip(e.ranges(i), (v[i].astype(np.int64), v[i + 1].astype(np.int64)) if n > 1 else (i, i), strict=True))
        lo = rng.integers(0, n, len(x))
        hi = np.minimum(n, lo + rng.integers(0, 30, len(x)))
        at = e.find(x, lo, hi)
        for y, a, b, k in zip(x, lo, hi, at, strict=True):
            assert (k >= 0) == (y in v[a:b]) and (k < 0 or (a <= k < b and v[k] == y))


def test_elias_fano_many_words():
    """Sequences of more words than lie between two counted ones, with long runs of ones and of zeros."""
    rng = np.random.default_rng(1)
    spread = rng.integers(0, 1 << 22, 60_000)
    for v in (spread, np.concatenate([spread // 512, spread + (1 << 21)]), np.repeat(rng.integers(0, 1 << 30, 9), 3000)):
        v = np.sort(v).astype(np.uint64)
        e = EliasFano.build(v)
        x = np.concatenate([v, rng.integers(0, int(v[-1]) + 9, 5000).astype(np.uint64)])
        assert (e.successor(x) == np.searchsorted(v, x)).all()
        assert ((e.find(x) >= 0) == np.isin(x, v)).all()


def test_language_model(docs, empty):
    model = language_model.train(docs, least=2, order=2)
    sents = [[*WORD.findall(lower(t)), b" "] for _, t in ROWS]
    c = collections.Counter(x for s in sents for x in s)
    pairs = collections.Counter(p for s in sents for p in zip([b" ", *s[:-1]], s, strict=True))
    pairs = {k: v for k, v in pairs.items() if v > 1}
    n, v = sum(c.values()), len(c)
    mass = collections.Counter()
    for (a, _), k in pairs.items():
        mass[a] += k - 0.75
    want = []
    for (i, _), s in zip(ROWS, sents, strict=True):
        total = 0.0
        for a, b in zip([b" ", *s[:-1]], s, strict=True):
            back = (1 - mass[a] / c[a]) * (c[b] + 1) / (n + v + 1)
            total += math.log10((pairs[a, b] - 0.75) / c[a] + back if (a, b) in pairs else back)
        want.append((i or -1, len(s), len(s), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in s), total))
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score(docs, model).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and abs(g[5] - w[5]) < 3e-4 * w[1]
    assert language_model.score(empty, model).count() == 0
    none = language_model.score(docs, language_model.train(empty)).collect()
    assert len(none) == len(ROWS) and all(r.train_tokens == 0 and r.n_known == 0 for r in none)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_whole_counts(docs, order):
    """Pairs and triples that are seen once count."""
    rows = [r for r in ROWS if r[0] != 3]
    model = language_model.train(docs.filter("doc_id is null or doc_id <> 3"), least=1, order=order)
    sents = lambda rows: [[*WORD.findall(lower(t)), b" "] for _, t in rows]
    c = collections.Counter(x for s in sents(rows) for x in s)
    pairs = collections.Counter(p for s in sents(rows) for p in zip([b" ", *s[:-1]], s, strict=True))
    triples = collections.Counter(p for s in sents(rows) for p in zip([b" ", *s], s, s[1:], strict=False))
    n, v = sum(c.values()), len(c)
    after, after2 = collections.Counter(a for a, _ in pairs), collections.Counter((a, b) for a, b, _ in triples)
    share = lambda k, total: max(k - 0.75, 0) / total
    want = []
    for (i, _), s in zip(ROWS, sents(ROWS), strict=True):
        total = 0.0
        for k, w in enumerate(s):
            a = s[k - 1] if k else b" "
            p = (c[w] + 1) / (n + v + 1)
            if c[a]:
                p = share(pairs[a, w], c[a]) + 0.75 * after[a] / c[a] * p
            context = (s[k - 2] if k > 1 else b" ", a)
            if order == 3 and k and pairs[context]:
                p = share(triples[*context, w], pairs[context]) + 0.75 * after2[context] / pairs[context] * p
            total += math.log10(p)
        want.append((i or -1, len(s), total))
    got = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in language_model.score(docs, model).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 3e-4 * w[1]


class _Mapped:
    """In place of a DataFrame: mapInArrow gives the function itself."""

    def select(self, *_):
        return self

    def mapInArrow(self, make, _):
        return make


def test_language_model_memory(docs):
    """What scoring holds at once is bounded, for a batch of 8 MB below 26 times its bytes."""
    words = WORD.findall(lower(ROWS[11][1]))
    pick = np.random.default_rng(3).integers(len(words), size=1_600_000)
    texts = [b" ".join(words[i] for i in x).decode() for x in np.split(pick, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], ["doc_id", "text"])
    score = language_model.score(_Mapped(), language_model.train(docs))
    tracemalloc.start()
    rows = sum(x.num_rows for x in score(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400 and most < 26 * sum(map(len, texts)), most / sum(map(len, texts))


@pytest.mark.parametrize("longest,block,common", [(96, 1 << 20, 0), (8, 200, 7), (96, 300, 1000)])
def test_byte_bpe(docs, empty, longest, block, common):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    got = byte_bpe.encode(docs, path, P.PATTERN, block_bytes=block, longest=longest, common=common).collect()
    want = [(i, (ids := library.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t in ROWS]
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got], key=str) == sorted([(i, len(ids), b, t) for i, ids, b, t in want], key=str)
    assert byte_bpe.encode(empty, path, P.PATTERN).count() == 0


def test_byte_bpe_dictionary_memory(docs, monkeypatch):
    """A worker holds the broadcast dictionary as it is, not a Python object for each word."""
    often = [f" w{i}" for i in range(200_000)]
    made = []
    monkeypatch.setattr(byte_bpe, "common_words", lambda *_: (pa.array(often), pa.array([b""] * len(often)), pa.array([b""] * len(often))))
    monkeypatch.setattr(byte_bpe.T, "released", lambda make: made.append(make) or make)
    byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a w7 b w7", None])], ["doc_id", "text"])
    tracemalloc.start()
    [row] = made[0](iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    places = np.frombuffer(row.column(2)[0].as_py(), "<i4").tolist()
    assert places[1] == places[3] == 7 and {places[0], places[2]} == {200_000, 200_001} and most < 10e6, (places, most)


def test_byte_bpe_block_size(docs, monkeypatch):
    """What the JVM gets in a row follows the block, not the batch of 4 MB."""
    words = sorted({w for _, t in ROWS for w in (t or "").split()})
    pick = np.random.default_rng(3).integers(len(words), size=800_000)
    texts = [" ".join(words[i] for i in x) for x in np.split(pick, 800)]
    often, made = [f" w{i}" for i in range(200_000)], []
    monkeypatch.setattr(byte_bpe, "common_words", lambda *_: (pa.array(often), pa.array([b""] * len(often)), pa.array([b""] * len(often))))
    monkeypatch.setattr(byte_bpe.T, "released", lambda make: made.append(make) or make)
    byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(texts)], ["doc_id", "text"])
    sizes = [(row.nbytes, len(row.column(0)[0])) for row in made[0](iter([batch]))]
    assert sum(n for _, n in sizes) == 800 and max(b for b, _ in sizes) < 1 << 20, max(sizes)


def test_byte_bpe_words_looked_up():
    """Words of the dictionary by their places, others (also longer, empty and of equal hash) by none or, at worst, not found."""
    words = ["a", " b", "é", " the", "x" * 24, "\n"]
    found = byte_bpe._Dictionary.of(pa.array(words))
    assert found.numbers(pa.array([" the", "", "x" * 25, "é", "b", "\n", "a", "x" * 24, "a "])).tolist() == [3, -1, -1, 2, -1, 5, 0, 4, -1]
    assert found.numbers(pa.array(words).slice(2, 2)).tolist() == [2, 3] and found.numbers(pa.array([], pa.string())).tolist() == []
    found.hashes[:] = found.hashes[0]
    assert set(found.numbers(pa.array(words)).tolist()) <= {-1, *range(6)} and found.numbers(pa.array(["zz"])).tolist() == [-1]
    assert byte_bpe._Dictionary.of(pa.array([], pa.string())).numbers(pa.array(["a"])).tolist() == [-1]


def test_batches_of_the_operator_or_the_session(spark):
    """Each operator bounds its own batches; what the session says holds."""
    from corvid.llm.scratch import bounded_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.newSession()
    bounded_batches(own)
    bounded_batches(own, byte_bpe.BATCH)
    assert own.conf.get(key) == byte_bpe.BATCH
    bounded_batches(own)
    assert own.conf.get(key) == "8m"
    own.conf.set(key, "3m")
    bounded_batches(own, byte_bpe.BATCH)
    assert own.conf.get(key) == "3m"


def test_rows_with_equal_32_bit_hashes(spark):
    """Null doc_ids and texts whose 32-bit hashes collide: each row keeps its own text."""
    texts = spark.range(300_000).select(F.regexp_replace(F.lit("a# b# c# d#"), "#", F.col("id").cast("string")).alias("t"))
    a, b = texts.groupBy(F.hash("t")).agg(F.sort_array(F.collect_list("t")).alias("ts")).filter("size(ts) > 1").first().ts[:2]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(None, a), (None, b), (None, a), (None, b)]
    got = exact_dedup.exact_duplicates(frame(rows)).drop("row_hash").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, 2, True, hashlib.sha256(t.encode()).hexdigest()) for _, t in rows], key=str)
    rows = [(None, a), (None, b), (1, a)]
    assert sorted(map(tuple, FingerprintIndex(spark, width=3, gram=2).deduplicate(frame(rows)).collect()), key=str) == brute_substring([rows], 3)
    long = [f"{t} {prose(70 + i, 60)}" for i, t in enumerate((a, b))]
    rows = [(None, a), (None, b), (1, a), (2, long[0]), (3, long[0] + " end"), (None, long[1])]
    assert sorted(map(tuple, near_dedup.near_duplicates(frame(rows)).drop("row_hash").collect()), key=str) == brute_components(rows)


def test_pipeline_keeps_one_row_of_each_group(docs):
    """Rows that repeat doc_id and text, and groups whose doc_ids are all null."""
    import corpus_pipeline

    spark = docs.sparkSession
    rows = [(13, prose(5, 50)), (13, prose(5, 50)), (None, prose(4, 50)), (None, prose(4, 50)), (None, prose(4, 50) + " more"), (7, prose(7, 50)), (None, prose(7, 50)), (13, prose(8, 50)), (None, "")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    plain = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)
    exact = corpus_pipeline.drop_copies(spark, d, "")
    assert exact.columns == d.columns
    assert plain(exact) == sorted([rows[i] for i in (0, 2, 4, 5, 7, 8)], key=str)
    near = corpus_pipeline.drop_near_copies(spark, d, "").collect()
    assert sorted(str(r.doc_id) for r in near) == ["13", "13", "7", "None", "None"]
    mixed = corpus_pipeline.mix_sources(spark, d, "")
    assert mixed.count() == mixing.mix(d).agg(F.sum("copies")).first()[0]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    sets = [pool[:1000], pool[143:1143], pool[:3], pool[:3], pool[1500:1501]]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = near_dedup.sketches(np.concatenate(sets), off)
    assert (s != near_dedup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 857 / 1143) < 0.15
    assert (s[2] == s[3]).all() and not (s[0] == s[4]).any()


def brute_components(rows, k=5):
    sets = []
    for _, t in rows:
        ws = WORD.findall(lower(t))
        sets.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(sets[a]), least, i == least))
    return sorted(out, key=str)


def test_near_dedup(docs, empty):
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).drop("row_hash").collect()), key=str) == brute_components(ROWS)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_chains(spark):
    """Texts that slide along one long text: neighbours link, ends don't, and no member is near all."""
    words = prose(50, 400).split()
    rows = [(100 - i, " ".join(words[4 * i : 4 * i + 60])) for i in range(40)] + [(200 + i, prose(60 + i, 60)) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(d).drop("row_hash").collect()), key=str) == brute_components(rows)


def test_near_dedup_large_group(spark):
    """Edited copies near and far from their original, cut copies, and copies of a far copy: all links, none by squares."""
    import random

    r, words = random.Random(5), prose(70, 160).split()

    def edited(ws, share):
        return [prose(r.randrange(10**6), 1) if r.random() < share else w for w in ws]

    far = edited(words, 0.12)
    texts = [edited(words, r.choice((0.01, 0.02, 0.03, 0.05, 0.1, 0.2))) for _ in range(150)]
    texts += [words[: 160 - 2 * i] for i in range(40)] + [words[3 * i :] for i in range(25)] + [edited(far, 0.02) for _ in range(60)] + [edited(words[: r.randrange(60, 160)], 0.01) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(d).drop("row_hash").collect()), key=str) == brute_components(rows)


def test_byte_bpe_long_words():
    """Words of any length merge as the library merges them."""
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for word in ("z" * 5000, "ab" * 700, "é" * 300, prose(3, 500).replace(" ", ""), "a", ""):
        assert byte_bpe.merge_long(word.encode(), path) == library.encode_ordinary(word)


def test_components_end_when_all_are_stars(spark, monkeypatch):
    """No links and stars take no round, chains as many as they need; labels against a search by hand."""
    from corvid.llm import near_dedup

    rounds = []
    stage = near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    chain = [(i, i + 1) for i in range(20)]
    for links, most in (([], 1), ([(1, 5), (7, 1), (9, 9), (2, 3)], 1), ([*chain, (50, 40), (60, 50), (40, 60), (8, 3)], 9)):
        rounds.clear()
        got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = {x: x for e in links if e[0] != e[1] for x in e}
        for _ in want:
            for a, b in links:
                if a != b:
                    want[a] = want[b] = min(want[a], want[b])
        assert got == want and 1 <= len(rounds) <= most


def test_words_encoded_together_as_alone():
    """Ids of odd words from one call for many equal those of a fresh tokenizer for each, in fewer texts than words."""
    from tokenizers import Tokenizer

    from corvid.llm.token_records import Encoder

    path = P.path("word_bpe_49k.json")
    odd = ["<|endoftext|>", "a<|endoftext|>b", "<|", "|>", "<|ENDOFTEXT|>", "endoftext|", "\u0338x", "x\u0301", "\u00a0a\u00a0", "\u2003", "\x00", "\u200d", "İ", "don't", "!!??", "日本語", "\U0001f600\u0338", "\ufffe"]
    words = [*odd, *[f"w{i}{c}" for i in range(50) for c in ("", "'s", "\u0338")], *reversed(odd)]
    encoder, fresh = Encoder(path, 1), Tokenizer.from_file(path)
    got = encoder._ids(words)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == [fresh.encode(w, add_special_tokens=False).ids for w in words]
    assert encoder.mark is not None


def test_pipeline_drops_tables_of_written_stages(spark, docs, tmp_path):
    """The next stage deletes them when it is given the written result, and not before."""
    import corpus_pipeline
    from corvid.llm import scratch

    docs.write.parquet(str(tmp_path / "docs"))
    given = spark.read.parquet(str(tmp_path / "docs"))
    before = set(scratch.owned(spark))
    first = corpus_pipeline.drop_copies(spark, given, "")
    made = set(scratch.owned(spark)) - before
    again = corpus_pipeline.drop_copies(spark, given, "")
    corpus_pipeline.drop_near_copies(spark, first, "")
    assert made and made <= set(scratch.owned(spark)) and first.count() == again.count()
    first.write.parquet(str(tmp_path / "kept"))
    near = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "kept")), "")
    assert not made & set(scratch.owned(spark)) and before <= set(scratch.owned(spark))
    assert 0 < near.count() <= spark.read.parquet(str(tmp_path / "kept")).count()
