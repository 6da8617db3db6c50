"""Query op5 over ``pages`` and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .url_filters import UrlRule, filter_urls

RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _fits(r: UrlRule) -> str:
    return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"


_WHENS = sorted(RULES, key=lambda r: -len(r.text))

SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), b AS (
  SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM a
), c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b
)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _WHENS)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _WHENS)} ELSE 'allow' END AS verdict
FROM c
"""

QUERIES = {"op5_url_filters": op5_url_filters}
ORACLES = {"op5_url_filters": SQL}
