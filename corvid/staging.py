"""Written intermediate tables for iterative operators: lineage ends at files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        app = spark.sparkContext.applicationId
        found = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="corvid-")
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/corvid/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
