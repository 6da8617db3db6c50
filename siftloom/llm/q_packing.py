"""Query op9 over ``documents``; tests compare it with one-by-one packing and the library's ids."""

from pyspark.sql import DataFrame, SparkSession

from .packing import pack_documents
from .q_bpe import vocabulary


def op9_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, path or vocabulary("word_bpe_49k.json"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict = {}
