"""Joins, aggregations and read models over groups, features, modules and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import trend, window_counts
from ..functions.text import risk_rank, rounded, trimmed
from ..plans.tables import numbered, running, saved


def listed(c: Column) -> Column:
    """Distinct values without null, in order."""
    return F.array_sort(F.collect_set(c))


def overlaps_or_open(a: Column, b: Column) -> Column:
    """Whether two arrays share a value; an empty one fits all."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def with_parent(features: DataFrame, key: str = "id", parent: str = "parent_id", label: str = "label") -> DataFrame:
    """``features`` plus ``path``: the label after its parent's, if it has one."""
    up = features.select(F.col(key).alias("__up"), F.col(label).alias("__label"))
    out = features.join(up, F.col(parent) == F.col("__up"), "left")
    return out.withColumn("path", F.when(F.col("__label").isNotNull(), F.concat("__label", F.lit(" › "), F.col(label))).otherwise(F.col(label))).drop("__up", "__label")


def module_map(features: DataFrame) -> DataFrame:
    """Children by parent: (module, features)."""
    p, c = features.alias("p"), features.alias("c")
    return p.join(c, F.col("c.parent_id") == F.col("p.id")).groupBy(F.col("p.label").alias("module")).agg(listed(F.col("c.label")).alias("features"))


def module_links(edges: DataFrame, artifacts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(src_module, src_path, dst_module, dst_path, dst) of edges between different modules."""
    s, d = artifacts.alias("s"), artifacts.alias("d")
    e = edges.where(F.col("kind").isin(*kinds)).alias("e")
    both = e.join(s, F.col("e.src") == F.col("s.id")).join(d, F.col("e.dst") == F.col("d.id")).where(F.col("s.module") != F.col("d.module"))
    return both.select(F.col("s.module").alias("src_module"), F.col("s.path").alias("src_path"), F.col("d.module").alias("dst_module"), F.col("d.path").alias("dst_path"), F.col("d.id").alias("dst"))


def module_imports(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    return module_links(edges, artifacts, ("imports",)).groupBy(F.col("src_module").alias("module")).agg(listed(F.col("dst_module")).alias("imports"))


def module_blast(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """How many outside files call or import each module."""
    return module_links(edges, artifacts, ("imports", "calls")).groupBy(F.col("dst_module").alias("module")).agg(F.countDistinct("src_path").alias("dependents"))


def blast_radius(edges: DataFrame, artifacts: DataFrame, limit: int = 20) -> DataFrame:
    """The symbols that most files call, riskier ones first of equals."""
    calls = edges.where("kind = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    return calls.join(artifacts, "id").orderBy(F.desc("callers"), F.desc(risk_rank(F.col("risk_tier"))), "id").limit(limit)


def top_risk(groups: DataFrame, artifacts: DataFrame, key: str = "group_id", ids: str = "artifact_ids") -> DataFrame:
    """Per group the artifact of the highest risk score among its ids; null scores count as highest."""
    each = groups.select(key, F.explode_outer(ids).alias("id")).join(artifacts.select("id", "risk_score"), "id", "left")
    best = F.max_by("id", F.struct(F.when(F.col("id").isNull(), 0).when(F.col("risk_score").isNull(), 2).otherwise(1), F.coalesce("risk_score", F.lit(0)), F.col("id")))
    return each.groupBy(key).agg(best.alias("artifact"))


def group_summary(members: DataFrame) -> DataFrame:
    """Per group: members, highest severity rank, first feature, three first samples, versions."""
    rank = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    order = F.struct("created_at", "review_id")
    return members.groupBy("group_id").agg(
        F.count("*").alias("corroboration"), F.max(rank).alias("severity"), F.min_by("feature_id", order).alias("feature_id"), listed(F.col("app_version")).alias("versions"),
    )


def first_samples(members: DataFrame, n: int = 3, key: str = "group_id") -> DataFrame:
    """The ``n`` first reports of each group; a window keeps no more rows than that per key and task."""
    w = W.partitionBy(key).orderBy("created_at", "review_id")
    return members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def demand(reports: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct authors per feature, reports of merged features counted with the one they went into.

    Without author id and name each report is its own author. Features without reports have 0.
    """
    canon = features.select(F.col("id").alias("feature_id"), F.coalesce("merged_into", "id").alias("canon"))
    who = F.coalesce("author_id", "author_name", "source_id")
    n = reports.join(canon, "feature_id").groupBy("canon").agg(F.countDistinct(who).alias("demand"))
    return features.where("merged_into is null").select(F.col("id").alias("canon")).join(n, "canon", "left").select("canon", F.coalesce("demand", F.lit(0)).alias("demand"))


def resolution_stats(reports: DataFrame) -> DataFrame:
    """Per group: resolution reports, and defect reports after the last of them."""
    last = reports.where("is_resolution").groupBy("group_id").agg(F.count("*").alias("resolved"), F.max("ts").alias("last"))
    since = reports.where("is_defect and not is_resolution").join(last, "group_id").where("ts > last").groupBy("group_id").agg(F.count("*").alias("since"))
    n = reports.where("is_defect").groupBy("group_id").agg(F.count("*").alias("corroboration"))
    return n.join(last.select("group_id", "resolved"), "group_id", "left").join(since, "group_id", "left").select("group_id", "corroboration", F.coalesce("resolved", F.lit(0)).alias("resolved"), F.coalesce("since", F.lit(0)).alias("since"))


def trends(reports: DataFrame, now: Column, key: str = "group_id") -> DataFrame:
    """Per group: new, rising, declining or stable, by reports in the last two windows."""
    c = reports.groupBy(key).agg(*window_counts(F.col("ts"), now))
    return c.select(key, "n_times", "recent", "prior", trend(F.col("n_times"), F.col("recent"), F.col("prior")).alias("trend"))


def shares(df: DataFrame, dims: list[str], n: str = "n") -> DataFrame:
    """Counts per dimension and bucket with their share of the dimension."""
    total = df.groupBy(*dims).agg(F.sum(n).alias("__total"))
    return df.join(total, dims).withColumn("share", F.col(n) / F.col("__total")).drop("__total")


def psi(base: DataFrame, current: DataFrame) -> DataFrame:
    """Population stability per dimension of (dimension, bucket, n): stable, moderate or significant.

    Buckets that one side lacks count with a share of 1e-6.
    """
    b, c = shares(base, ["dimension"]), shares(current, ["dimension"])
    both = b.select("dimension", "bucket", F.col("share").alias("p")).join(c.select("dimension", "bucket", F.col("share").alias("q")), ["dimension", "bucket"], "full")
    p, q = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(1e-6)) for x in ("p", "q"))
    out = both.groupBy("dimension").agg(rounded(F.sum((q - p) * F.log(q / p)), 3).alias("psi"))
    return out.withColumn("drift", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("significant"))


def nearest_rank(df: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """Per key the values at sorted index min(n - 1, floor(p * n)), the mean and the count.

    Equal values are counted first; ranks are running sums over the counts by ranges of the value,
    so a key with many distinct values is ranked in many tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counts = numbered(counts, "v").drop("row")
    total = counts.groupBy(key).agg(F.sum("n").alias("total"), rounded(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 3).alias("mean"))
    upto = running(counts, key, "v", "bucket", "n").withColumn("upto", F.col("before") + F.col("n")).join(total, key)
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total"))), F.col("v")))
    return upto.groupBy(key).agg(F.first("total").alias("n"), F.first("mean").alias("mean"), *[at(p).alias(name) for name, p in points.items()])


def impact(calls: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """(source, reached, hop): what calls the sources, at first or second hand and so on, with the fewest calls between.

    ``calls`` has src and dst, ``sources`` id. A round joins only what the round before reached for the first
    time, so cycles end and hubs are met once a source; a source does not reach itself. Null ends are ignored.
    """
    back = saved(calls.select(F.col("dst").alias("reached"), F.col("src").alias("caller")).where("reached is not null and caller is not null and reached <> caller").distinct(), "calls")
    new = saved(sources.where("id is not null").select(F.col("id").alias("source"), F.col("id").alias("reached"), F.lit(0).alias("hop")).distinct(), "hop")
    seen = new
    while (hops is None or hops > 0) and new.limit(1).count():
        hops = None if hops is None else hops - 1
        step = new.join(back, "reached").select("source", F.col("caller").alias("reached"), (F.col("hop") + 1).alias("hop")).distinct()
        new = saved(step.join(seen, ["source", "reached"], "left_anti"), "hop")
        seen = seen.unionByName(new)
    return seen.where("hop > 0")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(rounded(part / whole, 3))


def decisions_by_band(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved, rejected and open proposals by band, with the share approved of those decided."""
    key = ["repo", "kind", "ref_id"]
    j = proposals.join(decisions.select(*key, "decision"), key, "left")
    out = j.groupBy(F.coalesce("band", F.lit("unknown")).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision") == "rejected").alias("rejected"))
    decided = F.col("approved") + F.col("rejected")
    return out.withColumn("approval_pct", F.when(decided > 0, F.floor(F.col("approved") * 1000.0 / decided + 0.5) / 10))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an upsert leaves it."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def feature_list(features: DataFrame, limit: int = 90) -> DataFrame:
    """The first active features by label."""
    return features.orderBy("label", "id").limit(limit)


def module_summary(artifacts: DataFrame) -> DataFrame:
    """Files, symbols and the highest risk of every module."""
    rank = F.max(F.when(F.col("kind") == "symbol", risk_rank(F.col("risk_tier"))))
    return artifacts.groupBy("module").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols"), rank.alias("risk_rank"))


#: Ids of examples that a mention keeps.
EXAMPLES = 20


def mention_candidates(mentions: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(normalized, n, first_seen, last_seen, examples) of mentions (mention, review_id, ts) that no feature has.

    Examples are the ids of the first ``most`` mentions by time; a window keeps no more of a mention.
    """
    rows = mentions.select(F.lower(trimmed(F.regexp_replace("mention", r"\s+", " "))).alias("normalized"), "review_id", "ts")
    n = rows.groupBy("normalized").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("normalized").orderBy("ts", "review_id"))).where(F.col("k") <= most)
    first = first.groupBy("normalized").agg(F.array_sort(F.collect_list(F.struct("k", "review_id"))).alias("e"))
    return n.join(first, "normalized").select("normalized", "n", "first_seen", "last_seen", F.col("e.review_id").alias("examples"))


def gauges(samples: DataFrame, order: list[str]) -> DataFrame:
    """(name, value): the last value of every gauge by ``order``."""
    return samples.groupBy("name").agg(F.max_by("value", F.struct(*order)).alias("value"))
