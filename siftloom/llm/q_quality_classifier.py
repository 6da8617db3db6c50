"""Query op7 over ``documents``; held-out accuracy is tested."""

from pyspark.sql import DataFrame, SparkSession

from .quality_classifier import held_out, score, train


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict = {}
