"""op1: words of 35-word windows that start elsewhere in `documents` too are removed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.substring_dedup import FingerprintIndex
from corvid.session import table

NAME = "op1_substring_dedup"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = FingerprintIndex(spark, width=35).deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM s
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM d
), l AS (
  SELECT doc_id, list(j) AS js FROM r GROUP BY doc_id
), k AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w
), t AS (
  SELECT k.doc_id, string_agg(x, ' ' ORDER BY k.j) AS kept FROM k ANTI JOIN r ON k.doc_id = r.doc_id AND k.j = r.j GROUP BY k.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""
