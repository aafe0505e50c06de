"""Near-duplicate components by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of `shingle` words (A-Z lower-cased), or its whole word
sequence as one where it has fewer; documents without words have an empty set and link with nothing.
Documents link if 100 * |A & B| >= 100 * threshold * |A | B|, on full sets.

Sketch (Dahlgaard, Knudsen, Thorup): in round i every element is hashed to one of t bins with a value
that orders by round first; bins keep minima; rounds go on until all bins of a set are filled, and
rounds t to 2t - 1 hash into bin i - t, so that every coordinate fills. With t = 128 in 32 bands of 4,
a pair of similarity 0.75 shares no band with probability 5e-6.

Documents with equal sets are one class first, so that groups of copies cost one row. In each band
bucket the members are verified against its centre, the member that meets most others over all bands
(the original in a group of edited copies, which are nearer to it than to each other); links are
contracted to components. Members of a bucket in different components still are sought by what they have
beside their centre, in an inverted index, and by the sizes of their differences from it (_open_pairs):
all pairs that may link are verified, and their number follows what members share beside the centre,
not the square of the bucket. No step collects a group into one task.

Defined cases: null or empty text, or white space only: n_shingles 0, a component of its own; equal
doc_ids with equal texts share all results; null doc_ids are allowed and never are a component's id
unless it has no other; columns other than doc_id and text are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm import text as T
from corvid.llm.scratch import bounded_batches, row_digest, stage

_BASE = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and their n+1 offsets."""
    w = T.words(texts, lower=True)
    h = w.hashes()
    g, n = T.windows(h, k, _BASE), np.diff(w.bounds)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = dict(zip(short.tolist(), T.segments(h, w.bounds[short], n[short], _BASE + 2), strict=True)) if len(short) else {}
    sets = []
    for d, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            sets.append(np.array([whole[d]], np.uint64) if d in whole else np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketches(elements: np.ndarray, offsets: np.ndarray, t: int = 128) -> np.ndarray:
    """One row of t filled coordinates per set; empty sets have the greatest value everywhere. t: a power of 2 up to 128."""
    n = len(offsets) - 1
    out = np.full(n * t, _EMPTY, np.uint64)
    sizes = np.diff(offsets)
    open_ = sizes > 0
    owner = T.doc_of(offsets)
    x, own = elements, owner
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not open_.any():
                break
            y = T.mix(x + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            bins = (y & np.uint64(t - 1)).astype(np.int64) if i < t else np.full(len(x), i - t)
            np.minimum.at(out, own * t + bins, (np.uint64(i) << np.uint64(56)) | (y >> np.uint64(8)))
            live = np.flatnonzero(open_)
            done = (out.reshape(n, t)[live] != _EMPTY).all(axis=1)
            if done.any():
                open_[live[done]] = False
                keep = open_[own]
                x, own = x[keep], own[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of `rows` coordinates, different for each band."""
    bands = sketch.shape[1] // rows
    parts = sketch.reshape(len(sketch), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = T.mix(out * np.uint64(_BASE) + parts[:, :, i])
    return out


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(F.col("text")).alias("row_hash"), "text")


def signatures(docs: DataFrame, shingle: int, t: int, rows: int) -> DataFrame:
    """doc_id, row_hash, n_shingles, cls (128-bit digest of the set) and band keys of each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in T.pieces(batch, most=T.PIECE_BYTES // 4):
                elements, off = shingle_sets(T.column(x, "text"), shingle)
                keys = band_keys(sketches(elements, off, t), rows)
                n, ends = np.diff(off), off.tolist()
                cls = [xxhash.xxh3_128_digest(elements[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
                bands = keys.shape[1]
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                flat = pa.array(keys[n > 0].reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([T.column(x, "doc_id"), T.column(x, "row_hash"), pa.array(n), pa.array(cls, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], ["doc_id", "row_hash", "n_shingles", "cls", "bands"])

    return _docs(docs).mapInArrow(T.released(make), "doc_id long, row_hash binary, n_shingles long, cls binary, bands array<long>")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges (u, v) has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg((F.sum("up") + F.max("down")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] <= 1


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of `links` (a, b): the least node reachable, by alternating large and small stars until all are stars."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        edges = stage(small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets (na, nb) and of the intersection (both)."""
    a = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    b = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("both"))


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _family(stars: DataFrame, label: DataFrame) -> DataFrame:
    """The members of all families that have an open one: (a: the centre, b, n, more, less, label, open).

    stars: measured pairs of a centre and a member. more: elements the member has beside the centre's,
    less: those it lacks. open: in another component than the centre.
    """
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    named = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.col("nb").alias("n"), (F.col("nb") - F.col("both")).alias("more"), (F.col("na") - F.col("both")).alias("less"), F.col("na").alias("size"), F.coalesce("la", "a").alias("home"), F.coalesce("lb", "b").alias("label"))
    placed = stage(named.withColumn("open", F.col("label") != F.col("home")), "family")
    return placed.join(placed.filter("open").select("a").distinct(), "a", "left_semi")


def _sided(df: DataFrame, c: str, *by: str) -> DataFrame:
    return df.select(*by, F.col("b").alias(c), *[F.col(k).alias(f"{c}{k}") for k in ("n", "more", "less", "label", "open")], *([F.col("at").alias(f"{c}at")] if "at" in df.columns else []))


def _sharing(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of a family, one of them open, that share an element which the centre lacks and may link.

    An inverted index on the elements members have beside the centre's, each member's in order of the
    family's counts, rare ones first. A link needs all but a share of (100 - percent) % of either set, so
    that a member with more elements of its own than that is found by the first of them alone, and passages
    that many members share come last. Where members meet first, at places xat and yat, they can share no
    more than what follows. Elements of one component only are left out before members meet.
    """
    whole = lambda c, of: sets.select(F.col("cls").alias(c), F.col("elements").alias(of))
    rest = F.floor((100 - percent) * F.col("n") / 100).cast("int") + 1
    some = family.join(whole("a", "x"), "a").join(whole("b", "y"), "b")
    listed = stage(some.select("a", "b", "n", "more", "less", "label", "open", F.explode(F.array_except("y", "x")).alias("e")), "beside")
    met = listed.groupBy("a", "e").agg(F.count("*").alias("c"), (F.max("open") & (F.min("label") != F.max("label"))).alias("mixed"))
    places = Window.partitionBy("a", "b").orderBy("c", "e")
    index = stage(listed.join(met, ["a", "e"]).withColumn("at", F.row_number().over(places)).filter(F.col("mixed") & (F.col("at") <= rest)).drop("mixed", "c"), "index")
    shared = 1 + F.least(F.col("xmore") - F.col("xat"), F.col("ymore") - F.col("yat"))
    apart = F.col("xmore") + F.col("ymore") + F.abs(F.col("xless") - F.col("yless")) - 2 * shared
    may = (F.col("xlabel") != F.col("ylabel")) & ((100 + percent) * apart <= (100 - percent) * (F.col("xn") + F.col("yn")))
    return _sided(index.filter("open"), "x", "a", "e").join(_sided(index, "y", "a", "e"), ["a", "e"]).filter(may).select("x", "y")


def _lacking(family: DataFrame, percent: int, cells: int = 24) -> DataFrame:
    """Pairs (x, y) of a family, one of them open, that may link though they share nothing which the centre lacks.

    Then their symmetric difference is xmore + ymore and what they lack differently. Members are grouped
    by cells of (more, less); cells are paired where the bound can hold, and members within those.
    """
    apart = lambda more, gap: (100 + percent) * (more + gap)
    width = F.greatest(F.lit(1), F.floor(F.col("size") / cells))
    # Others have too much beside the centre's for a link that shares none of it.
    able = family.filter(100 * F.col("more") <= (100 - percent) * F.col("n"))
    gridded = able.withColumn("row", F.floor(F.col("more") / width).cast("int")).withColumn("col", F.floor(F.col("less") / width).cast("int"))
    cell = gridded.groupBy("a", "row", "col").agg(F.min("more").alias("more"), F.min("less").alias("least"), F.max("less").alias("most"), F.max("n").alias("n"), F.max("open").alias("open"), F.min("label").alias("l"), F.max("label").alias("m"))
    of = lambda c: cell.select("a", *[F.col(k).alias(f"{c}{k}") for k in cell.columns if k != "a"])
    gap = F.greatest(F.lit(0), F.col("xleast") - F.col("ymost"), F.col("yleast") - F.col("xmost"))
    mixed = (F.col("xl") != F.col("xm")) | (F.col("yl") != F.col("ym")) | (F.col("xl") != F.col("yl"))
    near = of("x").filter("xopen").join(of("y"), "a").filter(mixed & (apart(F.col("xmore") + F.col("ymore"), gap) <= (100 - percent) * (F.col("xn") + F.col("yn")))).select("a", F.col("xrow").alias("row"), F.col("xcol").alias("col"), "yrow", "ycol")
    x = _sided(gridded.filter("open"), "x", "a", "row", "col").join(near, ["a", "row", "col"]).drop("row", "col")
    y = _sided(gridded, "y", "a", "row", "col").withColumnsRenamed({"row": "yrow", "col": "ycol"})
    bound = apart(F.col("xmore") + F.col("ymore"), F.abs(F.col("xless") - F.col("yless"))) <= (100 - percent) * (F.col("xn") + F.col("yn"))
    return x.join(y, ["a", "yrow", "ycol"]).filter((F.col("xlabel") != F.col("ylabel")) & bound).select("x", "y")


def _open_pairs(stars: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket in different components that may link still, a < b; loses no link.

    Let X and Y be two members' differences from their centre, what they have beside it and what they lack.
    |x ^ y| = |X ^ Y|, so that a pair either shares an element beside the centre's or its distance is
    given but for what both lack. Both kinds are sought without comparing all members of a bucket.
    """
    family = stage(_family(stars, label), "families")
    found = _sharing(family, sets, percent).unionByName(_lacking(family, percent))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def full_sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """cls and all elements of the classes (cls, doc_id, row_hash)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in T.pieces(batch, most=T.PIECE_BYTES // 4):
                elements, off = shingle_sets(T.column(x, "text"), shingle)
                yield pa.RecordBatch.from_arrays([T.column(x, "cls"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(elements.view(np.int64)))], ["cls", "elements"])

    d = _docs(docs)
    r = classes.select("cls", F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"))
    return d.join(r, d.doc_id.eqNullSafe(r._id) & (d.row_hash == r._hash)).dropDuplicates(["cls"]).select("cls", "text").mapInArrow(T.released(make), "cls binary, elements array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.75, t: int = 128, rows: int = 4) -> DataFrame:
    """near_groups() without the label."""
    return near_groups(docs, shingle, threshold, t, rows).drop("label")


def near_groups(docs: DataFrame, shingle: int = 5, threshold: float = 0.75, t: int = 128, rows: int = 4) -> DataFrame:
    """One row per document: doc_id, row_hash, n_shingles, component_id (least doc_id reachable), label and kept.

    label: the same in each component and in no other; null for documents without words.

    shingle: at least 5 in production; threshold: share of the union; t and rows: coordinates of a
    sketch and of a band.
    """
    bounded_batches(docs.sparkSession)
    percent = round(100 * threshold)
    signed = stage(signatures(docs, shingle, t, rows), "signatures")
    classes = stage(
        signed.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "row_hash")).alias("at"), F.first("bands").alias("bands")).select("cls", "at.doc_id", "at.row_hash", "bands"),
        "classes",
    )
    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    sized = stage(banded.join(shared, "bucket"), "sized")
    company = sized.groupBy("cls").agg(F.sum("c").alias("met"))
    met = stage(sized.join(company, "cls"), "met")
    tops = met.groupBy("bucket").agg(F.max(F.struct("met", "cls")).alias("top"))
    members = stage(met.join(tops, "bucket").select("bucket", "cls", "c", "top"), "buckets")
    # The centre of a bucket may be an edited copy itself: families are around the greatest centre its centre meets.
    up = stage(members.groupBy("cls").agg(F.max("top").alias("top")).select("cls", F.col("top.cls").alias("to")), "centres")
    twice = up.join(up.select(F.col("cls").alias("to"), F.col("to").alias("root")), "to").select(F.col("cls").alias("a"), "root")
    star = members.select(F.col("top.cls").alias("a"), F.col("cls").alias("b"), "c")
    family = star.filter("c > 2").join(twice, "a").select(F.col("root").alias("a"), "b")
    pairs = star.select("a", "b", F.lit(False).alias("more")).unionByName(family.select("a", "b", F.lit(True).alias("more"))).filter("a <> b").groupBy("a", "b").agg(F.max("more").alias("more"))
    asked = members.select("cls").distinct()
    sets = stage(full_sets(docs, classes.join(asked, "cls"), shingle), "sets")
    stars = stage(measured(pairs.select("a", "b"), sets).join(pairs, ["a", "b"]), "stars")
    links = _linked(stars, percent)
    near = stage(components(links), "near")
    rest = stage(_open_pairs(stars.filter("more").drop("more"), near, sets, percent), "rest")
    # The links found last join whole components.
    of = lambda c: near.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    more = _linked(measured(rest, sets), percent).join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(more.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    last = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    label = near.join(last, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    label = label.unionByName(last.join(near, last["label"] == near["node"], "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label")))

    known = signed.select("doc_id", "row_hash", "n_shingles", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = known.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = known.join(least, "label", "left").select("doc_id", "row_hash", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "label")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
