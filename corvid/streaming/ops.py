"""Incremental forms: appended statistics and trees, live queries, and keyed heap state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start_append(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends a stream's rows to Parquet, at an interval or all there is now."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def track_heap(stream: DataFrame) -> DataFrame:
    """Latest event per allocation (owner, base) of a stream of (owner, seq, op, base, size): keyed state without expiry; live where op is alloc."""
    return stream.groupBy("owner", "base").agg(F.max_by(F.struct("op", "size"), "seq").alias("e")).select("owner", "base", "e.op", "e.size")


def live_buckets(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts and means per event-time window and type, closed by a watermark."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
