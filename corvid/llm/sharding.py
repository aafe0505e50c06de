"""Jump consistent hashing (Lamping and Veach) in column expressions.

A key's 64-bit linear congruential sequence decides at each step how far its shard jumps; no ring table
is kept, and one more shard takes only the keys that move into it. The 64-bit products are built from
32-bit limbs, because ANSI arithmetic does not wrap.

Defined cases: a null key counts as 0; equal keys share a shard, and rows with equal keys and different
texts are in different cells; slots of rows equal in all of that follow any order; null and empty texts
have size 1; long texts are only measured, never moved; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Multiplier of the generator, a fixed value of the published method.
MULTIPLIER = 2862933555777941757
_LOW = (1 << 32) - 1


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of key * MULTIPLIER + 1 modulo 2**64, in limbs of 32 bits; no product exceeds 2**49."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    p0, p1 = lo * F.lit(m_lo & 0xFFFF), lo * F.lit(m_lo >> 16)
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(_LOW)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftleft(F.shiftright(p1, 32), 16)

    def times(a: Column, b: int) -> Column:
        return (a * F.lit(b & 0xFFFF)) + F.shiftleft((a * F.lit(b >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)

    return (carry + times(lo, m_hi) + times(hi, m_lo)).bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The key's shard, 0 to shards - 1. A key jumps at most once per shard, so `shards` steps suffice."""
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(k, 32).alias("hi"), k.bitwiseAND(F.lit(_LOW)).alias("lo"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            s["j"].alias("at"),
            F.floor(F.shiftleft(s["j"] + 1, 31).cast("double") / (F.shiftright(hi, 1) + 1).cast("double")).cast("long").alias("j"),
        )
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: s["at"]).cast("int")


def with_slots(df: DataFrame, shard: str, *key: str, cells: int = 256) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard; key: columns that tell rows apart. df has no columns that begin with `_slot`.

    Rows are numbered in `cells` cells per shard, and each cell starts where the cells before it end: a
    shard's rows never meet in one task. The cells' sizes are a table of at most shards * cells rows.
    """
    celled = df.withColumn("_slot_cell", F.pmod(F.xxhash64(*key), F.lit(cells)).cast("int"))
    sizes = celled.groupBy(shard, "_slot_cell").agg(F.count("*").alias("_slot_n"))
    before = F.sum("_slot_n").over(Window.partitionBy(shard).orderBy("_slot_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(shard).alias("_slot_s"), F.col("_slot_cell").alias("_slot_c"), F.coalesce(before, F.lit(0)).alias("_slot_before"))
    numbered = celled.withColumn("_slot_rank", F.row_number().over(Window.partitionBy(shard, "_slot_cell").orderBy(*key)))
    joined = numbered.join(F.broadcast(starts), (numbered[shard] == starts["_slot_s"]) & (numbered["_slot_cell"] == starts["_slot_c"]))
    return joined.withColumn("slot", F.col("_slot_before") + F.col("_slot_rank") - 1).drop("_slot_cell", "_slot_rank", "_slot_s", "_slot_c", "_slot_before")


def shard_documents(docs: DataFrame, shards: int = 16, cells: int = 256) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot and grown_shard of each document.

    grown_shard: the shard with one shard more. A null text has no bytes. Columns other than doc_id and text are ignored.
    """
    key, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )
    return with_slots(rows, "shard", "doc_id", "text_crc32", "size", cells=cells)
