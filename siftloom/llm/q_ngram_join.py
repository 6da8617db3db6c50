"""Query op4 over ``documents`` and its SQL (all pairs that share a shingle, so for small tables)."""

from pyspark.sql import DataFrame, SparkSession

from .ngram_join import Similarity, similar_components


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_components(docs, Similarity(words=4, num=85, den=100))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), l AS MATERIALIZED (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c AS (
  SELECT DISTINCT a AS node, a AS seen FROM l
  UNION
  SELECT c.node, l.b FROM c JOIN l ON l.a = c.seen
), r AS (
  SELECT node, min(seen) AS root FROM c GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(r.root, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = d.doc_id
"""

QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLES = {"op4_ngram_join": SQL}
