"""Shared intermediate tables: written once as Parquet where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.text import trim

_OWN: dict[str, list[str]] = {}
#: The bounds of Arrow batches that operators have set, by application.
_BATCHES: dict[str, str] = {}
#: Folders of sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        app = spark.sparkContext.applicationId
        found = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="corvid-")
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; clean() removes those of a session."""
    path = f"{base_dir(spark)}/corvid/{name}-{uuid.uuid4().hex}"
    _OWN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: lineage ends at files that survive a lost executor."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_digest(text: Column) -> Column:
    """128 bits that tell texts apart where doc_ids are null or equal; null is a text of its own."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bounds the bytes of an Arrow batch to Python workers, where the session does not say: rows alone leave long texts unbounded. The bound of the operator before gives way."""
    key, app = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sparkContext.applicationId
    if spark.conf.get(key, None) in (None, _BATCHES.get(app)):
        spark.conf.set(key, most)
        _BATCHES[app] = most


def short_plans(spark: SparkSession, most: int = 200_000) -> None:
    """Bounds the descriptions of plans, where the session does not say: the driver keeps those of all queries, and literal tables would fill them."""
    key = "spark.sql.maxPlanStringLength"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def tidy_driver(spark: SparkSession) -> None:
    """Lets the driver give back what its last plans took, before the next large one: Python's, the heap's and, where the JVM has that command, the native memory that compiling code leaves with the allocator."""
    trim()
    jvm = spark._jvm
    jvm.System.gc()
    args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # The server's own class is not exported, its interface is.
    [invoke] = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        pass


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def owned(spark: SparkSession) -> list[str]:
    """The paths of this session's intermediate tables, oldest first."""
    return list(_OWN.get(spark.sparkContext.applicationId, []))


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes some of this session's intermediate tables."""
    own = _OWN.get(spark.sparkContext.applicationId, [])
    own[:] = [p for p in own if p not in paths]
    for path in paths:
        remove(spark, path)


def clean(spark: SparkSession) -> None:
    """Deletes this session's intermediate tables, once results that read them have been written."""
    for path in _OWN.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)
