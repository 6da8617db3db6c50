"""Query op10 over ``embeddings``; tests compare it with all pairs."""

from pyspark.sql import DataFrame, SparkSession

from .vector_dedup import near_vectors


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs, so for small tables; the links of the given tables lie well above the cosine.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS e FROM embeddings
), f AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), c AS (
  SELECT DISTINCT a AS node, a AS seen FROM p
  UNION
  SELECT c.node, p.b FROM c JOIN p ON p.a = c.seen
), r AS (
  SELECT node, min(seen) AS root FROM c GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(r.root, vec_id) AS component_id, coalesce(r.root, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN r ON r.node = v.vec_id
"""

QUERIES = {"op10_vector_dedup": op10_vector_dedup}
ORACLES = {"op10_vector_dedup": SQL}
