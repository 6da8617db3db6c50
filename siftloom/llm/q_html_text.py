"""Query op13 over ``pages`` and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .html_text import extract


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: For pages whose main text is one article element of headings and paragraphs with b and br within, as in the given table.
SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages
), b AS (
  SELECT page_id, url, regexp_split_to_array(a, '</?(?:h1|p)>') AS b FROM a
), c AS (
  SELECT page_id, url, list_transform(b, lambda x: replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', '''')) AS c FROM b
), d AS (
  SELECT page_id, url, list_transform(c, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS d FROM c
), e AS (
  SELECT page_id, url, array_to_string(list_filter(d, lambda x: x <> ''), chr(10)) AS text FROM d
)
SELECT page_id, url, text, length(text) AS n_chars FROM e
"""

QUERIES = {"op13_html_text": op13_html_text}
ORACLES = {"op13_html_text": SQL}
