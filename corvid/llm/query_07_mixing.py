"""op7: `documents` mixed to 150 % of their words with source weights 5, 2, 1."""

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.mixing import mix
from corvid.session import table

NAME = "op7_mixing"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    greatest(0.01::DOUBLE, 1 - len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::DOUBLE / greatest(1, length(coalesce(text, '')))) AS q,
    (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || md5(coalesce(text, ''))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2.0::DOUBLE * sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * w) AS target FROM l
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS e,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target, CAST(size * (e + CASE WHEN e < 2 AND start + size / 2.0::DOUBLE <= target - e * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k
"""
