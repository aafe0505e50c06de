"""Training-data pipeline over `documents`: each stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.
A stage that is given the written result of the one before deletes that one's intermediate tables first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from corvid.llm.scratch import drop, owned, row_digest, stage
from corvid.session import table

#: By application: the intermediate tables of the stages that wait for their results to be written, and the files these stages read.
_WAITING: dict[str, tuple[list[str], set[str]]] = {}


def _chained(function: Callable) -> Callable:
    """A stage after which the next one deletes the intermediate tables, if it reads files, other ones than this stage and none of the tables: then the result has been written."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app, files = spark.sparkContext.applicationId, set(docs.inputFiles())
        if not files:
            return function(spark, docs, sf_dir)
        made, read = _WAITING.pop(app, ([], set()))
        if not files & read and not any(path.rsplit("/", 1)[1] in f for path in made for f in files):
            drop(spark, made)
            made, read = [], set()
        before = set(owned(spark))
        out = function(spark, docs, sf_dir)
        _WAITING[app] = [*made, *(p for p in owned(spark) if p not in before)], read | files
        return out

    return run


def _rows(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """docs joined with chosen (doc_id, row_hash and more) row by row; null doc_ids are equal here."""
    c = chosen.withColumnsRenamed({"doc_id": "_chosen_id", "row_hash": "_chosen_hash"})
    return docs.join(c, docs["doc_id"].eqNullSafe(c["_chosen_id"]) & (row_digest(docs["text"]) == c["_chosen_hash"]), how)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a written number of each row."""
    return stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _one_of_each(docs: DataFrame, kept: DataFrame, group: str) -> DataFrame:
    """Of each group of kept (doc_id, row_hash, group) the first row; rows of no group all stay."""
    rows = _keyed(docs)
    alone = F.when(F.col(group).isNull(), F.col("_row"))
    chosen = _rows(rows.select("doc_id", "text", "_row"), kept.select("doc_id", "row_hash", group).distinct(), "inner")
    first = chosen.groupBy(group, alone.alias("_alone")).agg(F.min("_row").alias("_row")).select("_row")
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


@_chained
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_chained
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the least doc_id."""
    return _one_of_each(docs, exact_dedup.exact_duplicates(docs).filter("kept"), "text_sha256")


@_chained
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, with the least doc_id."""
    return _one_of_each(docs, near_dedup.near_groups(docs).filter("kept"), "label")


@_chained
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = _keyed(docs)
    taken = mixing.mix(rows, row=F.col("_row")).filter("copies > 0").select(F.col("row_hash").alias("_row"), F.col("copies").alias("_copies"))
    return rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


@_chained
def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (32-bit little-endian) and the digest of the decoded bytes."""
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: Toxicity, near duplicates and encoding have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
