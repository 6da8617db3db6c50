"""Query op12 over ``documents`` and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fill_middle import fill_in_middle, restored


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fim = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fim.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha(F.col("fim.output")).alias("output_sha256"), sha(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id::varchar) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
         ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM d
), f AS (
  SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f
), c AS (
  SELECT *, length(pre) AS pc, length(mid) AS mc FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN pc END AS prefix_chars, CASE WHEN form <> 'plain' THEN mc END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

QUERIES = {"op12_fill_middle": op12_fill_middle}
ORACLES = {"op12_fill_middle": SQL}
