"""Query op8 over ``documents`` and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import RULES, STOP_WORDS, judge


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = judge(docs)
    return q.select("doc_id", *[F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _rules_sql() -> str:
    parts = []
    for r in RULES:
        ratio = f"({r.over}::double / greatest({r.under}, 1))"
        parts += [f"{ratio} >= {r.least}"] if r.least is not None else []
        parts += [f"{ratio} <= {r.most}"] if r.most is not None else []
    return " AND ".join(parts)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), tri AS (
  SELECT rid, unnest(range(1, greatest(len(w) - 1, 1))) AS p, w FROM w
), tri2 AS (
  SELECT rid, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM tri
), dup AS (
  SELECT rid, p FROM tri2 QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1
), cov AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY rid
), f AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         len(list_filter(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 3)) AS n_short_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {_rules_sql()}) AS kept
FROM b
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": SQL}
