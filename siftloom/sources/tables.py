"""Table scans and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code_risk
from ..functions.vectors import local_embedding

#: What a raw review holds.
RAW_REVIEW = (
    "source string, source_id string, text string, title string, rating double, locale string, app_version string, platform string, "
    "author struct<id:string,name:string>, created_at timestamp, ingested_at timestamp, raw_payload string"
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows: source, id and text must not be empty, a rating lies in 1 to 5, creation before ingestion."""
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    rated = F.col("rating").isNull() | F.col("rating").between(1, 5)
    ordered = F.coalesce(F.col("created_at") <= F.col("ingested_at"), F.lit(False))
    good = filled("source") & filled("source_id") & filled("text") & rated & ordered
    return raw.where(good), raw.where(~good)


def seeded(spark: SparkSession, features: list[dict], artifacts: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Registries of features and artifacts kept by hand, each with the vector of its joined texts.

    A feature has repo, id, label, description, aliases, parent_id, module; an artifact repo, id, kind,
    path, module, symbol, feature_ids, description. What is left out is null; ids that repeat keep the last entry.
    """
    last = lambda rows: list({(r.get("repo"), r["id"]): r for r in rows}.values())
    f = spark.createDataFrame([tuple(r.get(c) for c in ("repo", "id", "label", "description", "aliases", "parent_id", "module")) for r in last(features)], "repo string, id string, label string, description string, aliases array<string>, parent_id string, module string")
    a = spark.createDataFrame([tuple(r.get(c) for c in ("repo", "id", "kind", "path", "module", "symbol", "feature_ids", "description")) for r in last(artifacts)], "repo string, id string, kind string, path string, module string, symbol string, feature_ids array<string>, description string")
    risk = code_risk(F.col("path"), F.col("module"), F.col("symbol"))
    f = f.withColumn("v", local_embedding(F.concat_ws(" ", "label", "description", "aliases"))).withColumn("state", F.lit("grounded"))
    return f, a.withColumn("v", local_embedding(F.concat_ws(" ", "module", "symbol", "path", "description"))).withColumn("risk_tier", risk["tier"]).withColumn("risk_score", risk["score"])


def review_id(*key: Column) -> Column:
    """The same id for the same natural key on every run."""
    return F.sha2(F.concat_ws("\x1f", *key), 256)


def at_path(doc: Column, path: str, kind: str = "string") -> Column:
    """The value at a JSON path (names with dots, places as [n]) as ``kind``; null where the path or the cast fails."""
    return F.get_json_object(doc, f"$.{path}").try_cast(kind)
