"""op5: `documents` in shards 0 to 15 under the law `key`."""

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.sharding import MULTIPLIER, shard_documents
from corvid.session import table

NAME = "op5_sharding"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def _jump(shards: int) -> str:
    """The shard in DuckDB: a fold over steps of [key, shard so far, next]."""
    step = (
        f"lambda s, i: CASE WHEN s.j >= {shards} THEN s ELSE "
        f"{{'k': ((s.k * {MULTIPLIER}::UHUGEINT) % 18446744073709551616::UHUGEINT + 1) % 18446744073709551616::UHUGEINT, 'a': s.j, "
        f"'j': CAST(floor(CAST((s.j + 1) * 2147483648 AS DOUBLE) / CAST((((s.k * {MULTIPLIER}::UHUGEINT) % 18446744073709551616::UHUGEINT + 1) % 18446744073709551616::UHUGEINT) // 8589934592::UHUGEINT + 1 AS DOUBLE)) AS BIGINT)}} END"
    )
    start = "{'k': CAST(coalesce(doc_id, 0) AS UHUGEINT), 'a': 0::BIGINT, 'j': 0::BIGINT}"
    return f"CAST(list_reduce(list_prepend({start}, list_transform(range(0, {shards + 1}), lambda x: {start})), {step}).a AS INTEGER)"


#: DuckDB has no crc32, so that the whole result has no SQL; SHARDS_SQL is the part that has (see the tests).
SHARDS_SQL = f"SELECT doc_id, {_jump(16)} AS shard, {_jump(17)} AS grown_shard FROM documents"
ORACLE_SQL = None
