"""Query op2 over ``pages`` and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .common import new_path
from .warc import read_chunks, records, write_archive


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_archive(pages, path, "page_id", "html", "url")
    return records(read_chunks(spark, path, payload=False)).withColumnRenamed("record_id", "page_id")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": SQL}
