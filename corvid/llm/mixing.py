"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words wanted, at most `most` times its own words; the
excess is shared again by weight. The fixpoint is least(most * size, level * weight) at one level,
which follows from the sources sorted by size over weight. A document's key is -ln(u) / quality, with u
from a digest of its doc_id and text: least keys first is weighted sampling without replacement. Complete epochs
take every document; the fraction left takes documents in key order while at least half of the document
fits the budget. Prefix sums run over `cells` key ranges per source: ranges before the boundary are
summed by aggregates, and rows are sorted within a range only, so that a source with a third of all
rows never meets in one task.

Defined cases: null or empty text has size 0 and is taken for nothing; null source is a source of its
own, last; ties of keys go by doc_id and size; reruns agree; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.scratch import row_digest, stage

_SPLIT = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column | str) -> Column:
    t = F.coalesce(text, F.lit("")) if isinstance(text, Column) else F.coalesce(F.col(text), F.lit(""))
    return F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def quality(text: Column) -> Column:
    """A document's quality weight, above 0 and at most 1: its share of characters that are not of `#*$%&|<>`."""
    junk = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]"))
    return F.greatest(F.lit(0.01), 1 - junk / F.greatest(F.lit(1), F.length(F.coalesce(text, F.lit("")))))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of the key's digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _cell(key: Column, cells: int) -> Column:
    """A range of keys, in their order. Keys of quality q spread like exponentials of mean 1 / q: a third of the cells for each of the means 1, 10 and 100."""
    return sum((F.floor(cells / 3 * (1 - F.exp(-key / mean))) for mean in (1.0, 10.0, 100.0)), F.lit(0).cast("long")).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target of each source; sizes: source and source_size, one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_k", F.row_number().over(order) - 1).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("_k") % len(weights)))
    all_ = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "_k")
    each = (share * F.sum("source_size").over(all_) - F.coalesce(most * F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("_each", each)
    # Capping a source whose share exceeds its cap raises the level, capping any other lowers it: the greatest is the fixpoint.
    return ranked.withColumn("_level", F.max("_each").over(all_)).select("source", "source_size", F.least(most * F.col("source_size"), F.col("_level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", cells: int = 1024, row: Column | None = None) -> DataFrame:
    """doc_id, row_hash (or `row`, which tells rows apart), size, source_size, target, taken and copies (times the document is in the mix)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (row_digest(F.col("text")) if row is None else row).alias("row_hash"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), quality(F.col("text")).alias("_q"), uniform(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))), seed).alias("_u"))
    keyed = d.withColumn("_key", -F.log(F.col("_u")) / F.col("_q")).withColumn("_cell", _cell(F.col("_key"), cells)).drop("_q", "_u")
    keyed = stage(keyed, "mix")  # texts are read once
    cell_sizes = keyed.groupBy("source", "_cell").agg(F.sum("size").alias("_words"))
    source_sizes = cell_sizes.groupBy("source").agg(F.sum("_words").alias("source_size"))
    goals = targets(source_sizes, weights, share, most)
    g = goals.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size")).withColumnRenamed("source", "_src")
    before_cell = F.coalesce(F.sum("_words").over(Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = cell_sizes.withColumn("_before", before_cell).join(g, F.col("source").eqNullSafe(F.col("_src"))).select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), "_before", "source_size", "target", "_epochs", "_left")
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    within = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size", "row_hash")
    start = F.col("_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    copies = (F.col("_epochs") + F.when((start + F.col("size") / 2 <= F.col("_left")) & (F.col("_epochs") < most), 1).otherwise(0)).cast("int")
    return rows.withColumn("copies", copies).select("doc_id", "row_hash", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
