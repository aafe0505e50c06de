"""Exact deduplication by a stateful stream with disk-backed keyed state.

Texts are equal when they are identical after each run of `[\x20\x09-\x0D]` becomes one space. Each
batch of documents is digested once into a table of (digest, doc_id, locator); a Structured Streaming
query reads what is new there and keeps, per digest and without expiry, the stable identifier (least
doc_id), the content locator of that row and the number of rows, in RocksDB state below the shared
folder. A digest that is hit more than once has its members' full normalised texts compared with the
text at the locator (least and greatest text of the members, by partial aggregates); members of a digest
with any difference are grouped by their texts instead.

Defined cases: null counts as empty, and empty texts equal each other; of equal texts the row with the
least doc_id stays; rows without doc_id stay only where none of their group has one; rows that repeat
both doc_id and text stay or go alike; columns other than doc_id and text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.scratch import fresh_dir, row_digest, stage

#: State on disk; without preallocated files, which would take megabytes for every state partition, and in bounded memory of an executor.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
_SEEN = "doc_id long, row_hash binary, digest binary, sha binary, file string"


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class StreamingDeduplicator:
    """State and its inputs below one folder; each call of ingest() goes on from the state of the last."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.path = path or fresh_dir(spark, "exact")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Digests docs and runs them through the state; returns their rows of the digest table."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(F.col("text")).alias("row_hash"), normalised(F.col("text")).alias("text"), F.input_file_name().alias("file"))
        n = getattr(self, "_batches", 0)
        self._batches = n + 1
        path = f"{self.path}/seen/batch={n}"
        rows.select("doc_id", "row_hash", self.digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha"), "file").write.parquet(path)
        self._advance()
        return self.spark.read.schema(_SEEN).parquet(path)

    def _advance(self) -> None:
        out = f"{self.path}/updates"

        def save(df: DataFrame, batch_id: int) -> None:
            df.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/{batch_id}")

        before = {k: self.spark.conf.get(k, None) for k in _STATE}
        for k, v in _STATE.items():
            self.spark.conf.set(k, v)
        try:
            state = (
                self.spark.readStream.schema(_SEEN)
                .parquet(f"{self.path}/seen/*")
                .groupBy("digest")
                .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min_by(F.struct("file", "row_hash"), "doc_id").alias("locator"))
            )
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).foreachBatch(save).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def state(self) -> DataFrame:
        """The latest (digest, keep_id, group_size, locator) of every digest seen."""
        schema = "digest binary, keep_id long, group_size long, locator struct<file:string,row_hash:binary>, version long"
        updates = self.spark.read.schema(schema).parquet(f"{self.path}/updates/*")
        return updates.groupBy("digest").agg(F.max_by(F.struct("keep_id", "group_size", "locator"), "version").alias("s")).select("digest", "s.*")

    def seen(self) -> DataFrame:
        return self.spark.read.schema(_SEEN).parquet(f"{self.path}/seen/*")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_digest(F.col("text")).alias("row_hash"), "text")
    m = members.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "digest", "keep_id")
    return d.join(m, d.doc_id.eqNullSafe(m._id) & (d.row_hash == m._hash)).select("doc_id", "row_hash", "digest", "keep_id", normalised(F.col("text")).alias("text"))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, row_hash, keep_id, group_size, kept and text_sha256."""
    stream = StreamingDeduplicator(docs.sparkSession, digest=digest)
    seen = stream.ingest(docs)
    groups = stage(stream.state(), "groups")
    rows = seen.join(groups.select("digest", "keep_id", "group_size"), "digest")
    members = rows.filter("group_size > 1").select("doc_id", "row_hash", "digest", "keep_id").distinct()
    hits = stage(_texts(docs, members), "hits")
    # The text at the locator is one of the members', so that all equal it if the least and the greatest text are equal; partial aggregates keep a large group from one task.
    differ = stage(hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most").select("digest"), "collisions")
    if not differ.isEmpty():
        fine = rows.join(differ, "digest", "left_anti").select("doc_id", "row_hash", "sha", "keep_id", "group_size")
        placed = hits.join(differ, "digest", "left_semi").select("doc_id", "row_hash", sha256(F.col("text")).alias("sha"), "text")
        by_text = placed.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        rows = fine.unionByName(placed.join(by_text, "text").select("doc_id", "row_hash", "sha", "keep_id", "group_size"))
    return rows.select("doc_id", "row_hash", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
