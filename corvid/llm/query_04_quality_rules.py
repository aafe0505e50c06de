"""op4: quality counts and verdict of every row of `documents`."""

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.quality_rules import report
from corvid.session import table

NAME = "op4_quality_rules"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1
), n AS (
  SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id
), c AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\\p{L}'))) AS n_lettered, len(list_distinct(ws)) AS n_distinct
  FROM w LEFT JOIN n ON n.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_lettered < 6 * n_words OR (n_words >= 50 AND n_distinct < 10) OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM c
"""
