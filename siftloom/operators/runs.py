"""One run from raw reviews to ranked proposals: process, group, reconcile, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import saved
from . import analytics as A
from . import insight as I
from . import reviews as R
from . import signals as G


@dataclass
class Run:
    """batch: what became of every review; members: reviews of each group; groups: after reconciliation; proposals: ranked."""

    batch: R.Batch
    members: DataFrame
    groups: DataFrame
    proposals: DataFrame


def _reports(processed: DataFrame, artifacts: DataFrame, repo: str) -> DataFrame:
    """Bugs and reports that one is gone, with the artifacts that their feature or area points to."""
    bug = (F.col("c.category") == "bug") & ~F.col("c.is_spam")
    rows = saved(processed.where(bug | F.col("c.is_resolution_report")), "reports")
    code = R.map_code(rows.where(bug).select("seq", "feature_id", "area"), artifacts).groupBy("seq").agg(A.listed(F.col("artifact_id")).alias("artifacts"))
    rows = rows.join(code, "seq", "left")
    return rows.select(
        F.lit(repo).alias("repo"), F.col("id").alias("review_id"), "created_at", (bug & ~F.col("c.is_resolution_report")).alias("is_defect"), F.col("v").alias("vector"), F.coalesce("artifacts", F.array().cast("array<string>")).alias("artifacts"), "canonical",
        F.col("c.severity").alias("severity"), "feature_id", "app_version", "platform", F.col("text_redacted").alias("text"),
    )


def from_reviews(raw: DataFrame, features: DataFrame, artifacts: DataFrame, edges: DataFrame, now: Column, repo: str = "app") -> Run:
    """The whole way. ``features`` has id, label, description, module and v; ``artifacts`` id, kind, path, module,
    feature_ids, risk_tier, risk_score and v; ``edges`` src, dst and kind between artifacts.

    Groups are assigned in order of arrival, merged where artifacts connect them, and proposed with their
    defects and resolutions; gaps and wishes are proposed with those who asked. An empty batch gives no rows.
    """
    batch = R.process(raw, features, repo)
    processed = batch.processed
    reports = saved(_reports(processed, artifacts, repo), "reports")
    assigned = saved(G.assign_in_order(reports.select("repo", "review_id", "created_at", "is_defect", "vector", "artifacts", "canonical")), "assigned")
    first = assigned.where("matched_by = 'new'").join(reports.select("review_id", "canonical", "artifacts", F.col("created_at").alias("first_seen")), "review_id")
    groups = saved(first.select(F.col("group_id").alias("id"), "canonical", "artifacts", "first_seen"), "groups")
    keep = saved(G.reconcile(groups), "keep")
    placed = assigned.join(keep.withColumnRenamed("id", "group_id"), "group_id").select("review_id", F.col("keep").alias("group_id"), "matched_by")
    members = saved(placed.join(reports.drop("canonical"), "review_id").withColumn("ts", F.col("created_at")).withColumn("is_resolution", ~F.col("is_defect")).withColumnRenamed("artifacts", "artifact_ids"), "members")
    defects = members.where("is_defect")
    own = assigned.where("matched_by <> 'resolution'").select("group_id", "review_id").join(reports.select("review_id", "app_version", "platform"), "review_id")
    merged = G.merged(groups, own, keep)

    blast = A.module_blast(edges, artifacts)
    bugs = I.bug_proposals(defects, members, artifacts, blast, now, repo)
    author = lambda part: F.col(f"author.{part}") if "author" in processed.columns else F.lit(None).cast("string")
    asks = processed.select("feature_id", "state", author("id").alias("author_id"), author("name").alias("author_name"), "source_id", F.col("created_at").alias("ts"))
    gaps = batch.gaps.select(F.col("feature_id").alias("id"), F.lit(None).cast("string").alias("merged_into"), "label", F.col("label").alias("description"))
    modules = artifacts.groupBy("module").agg(A.listed(F.col("symbol") if "symbol" in artifacts.columns else F.lit(None).cast("string")).alias("features"))
    gap = I.gap_proposals(asks.where("state = 'gap'"), gaps, modules, now, repo, blast)
    named = features.select("id", "label", F.col("module") if "module" in features.columns else F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("merged_into"))
    first_feature = A.group_summary(defects).select(F.col("group_id").alias("ref_id"), "feature_id")
    wish = I.enhancement_proposals(asks.where("state = 'enhancement'"), named, bugs.join(first_feature, "ref_id"), now, repo)
    return Run(batch, members, merged, I.ranked(bugs, gap, wish))
