"""Query op6 over ``documents``. Span positions are beyond plain SQL; tests hold a brute-force version."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .secret_scans import BASE, BlobLedger


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = BlobLedger(spark).scan(docs, "doc_id", "text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return rows.select(F.col("path").alias("doc_id"), *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))


QUERIES = {"op6_secret_scans": op6_secret_scans}
ORACLES: dict = {}
