"""Queries of intake, registries, decisions, keys of records, and versions of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import insight as I
from ..operators import reviews as R
from ..operators import signals as G
from ..plans.tables import shared_dir
from ..sources.store import Runs, Store
from ..sources.tables import load, validate


def validated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw reviews: how many of each source hold what a review must hold."""
    o = load(spark, sf_dir, "orders")
    raw = o.select(
        F.when(F.col("o_orderkey") % 17 == 0, "").when(F.col("o_orderkey") % 19 != 0, F.col("o_orderpriority")).alias("source"), F.col("o_orderkey").cast("string").alias("source_id"), F.when(F.col("o_custkey") % 23 != 0, F.col("o_orderstatus")).alias("text"),
        F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 7).cast("double")).alias("rating"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, o_orderkey % 5 - 1)")).alias("ingested_at"),
    )
    good, bad = validate(raw)
    both = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return both.groupBy("source", "ok").agg(F.count("*").alias("n"))


VALID_SQL = """
WITH r AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS source, CASE WHEN o_custkey % 23 <> 0 THEN o_orderstatus END AS text, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 7 END AS rating,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 5 - 1 END AS late FROM orders)
SELECT source, coalesce(source <> '' AND text <> '' AND (rating IS NULL OR rating BETWEEN 1 AND 5) AND late >= 0, false) AS ok, count(*) AS n FROM r GROUP BY ALL
"""


def module_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as code: files, symbols and the highest risk of every brand."""
    p = load(spark, sf_dir, "part")
    tier = F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 30, "high").when(F.col("p_size") > 10, "medium").otherwise("low")
    return A.module_summary(p.select(F.col("p_brand").alias("module"), F.when(F.col("p_partkey") % 3 == 0, "file").otherwise("symbol").alias("kind"), tier.alias("risk_tier")))


def feature_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 90 suppliers as features, by label."""
    return A.feature_list(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("label")))


def artifact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose suppliers and parts share a class, or of which a side has none."""
    line = load(spark, sf_dir, "lineitem")
    g = line.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey") % 9)).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey") % 9)).alias("b"))
    return g.select("l_orderkey", A.overlaps_or_open(F.col("a").cast("array<long>"), F.col("b").cast("array<long>")).alias("fits"))


OVERLAP_SQL = """
WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey % 9) FILTER (WHERE l_returnflag <> 'R') AS a, list(DISTINCT l_partkey % 9) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, a IS NULL OR b IS NULL OR list_has_any(a, b) AS fits FROM g
"""


def decisions_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests to decide on customers' proposals: the last valid one of each holds; and how many were refused."""
    key = [F.lit("app").alias("repo"), F.lit("bug_fix").alias("kind")]
    proposals = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(*key, F.col("c_custkey").cast("string").alias("ref_id"), F.col("c_name").alias("title"))
    verdict = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected").otherwise("later")
    note = F.when(F.col("o_orderkey") % 11 == 0, F.repeat(F.lit("x"), 2001)).otherwise("ok")
    requests = load(spark, sf_dir, "orders").select(*key, F.col("o_custkey").cast("string").alias("ref_id"), verdict.alias("decision"), note.alias("note"), F.lit("someone").alias("decided_by"), F.col("o_orderdate").alias("at"))
    taken, refused = I.decide(proposals, requests)
    return taken.select("ref_id", "decision", F.col("at").alias("ts")).unionByName(refused.groupBy().agg(F.count("*").cast("string").alias("ref_id")).select("ref_id", F.lit("refused").alias("decision"), F.lit(None).cast("timestamp").alias("ts")))


DECIDE_SQL = """
WITH r AS (SELECT o_custkey::varchar AS ref_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'later' END AS decision, o_orderdate AS ts, o_orderstatus IN ('F', 'O') AND o_orderkey % 11 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS ok FROM orders)
SELECT ref_id, arg_max(decision, (ts, decision)) AS decision, max(ts) AS ts FROM r WHERE ok GROUP BY 1 UNION ALL SELECT count(*)::varchar, 'refused', NULL FROM r WHERE NOT ok
"""


def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value, scaled to 1, lies in the band that is kept out of analytics."""
    ev = load(spark, sf_dir, "events").withColumn("c", F.col("value") / 100)
    return ev.groupBy("event_type").agg(F.count_if(T.is_low_confidence(F.col("c"))).alias("n_low"), F.count("*").alias("n"))


def gap_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and slug of a gap for every part: from its type, else its brand, else its name."""
    p = load(spark, sf_dir, "part")
    label = T.emergent_label(F.when(F.col("p_size") > 30, F.col("p_type")), F.when(F.col("p_size") > 15, F.col("p_brand")), F.concat(F.lit("  "), F.col("p_name"), F.lit("  and more words behind it  ")))
    return p.select("p_partkey", label.alias("label"), T.slug(label, F.lit("app")).alias("slug"))


SLUG_SQL = r"""
WITH l AS (SELECT p_partkey, substr(trim(coalesce(CASE WHEN p_size > 30 THEN p_type END, CASE WHEN p_size > 15 THEN p_brand END, '  ' || p_name || '  and more words behind it  ')), 1, 80) AS label FROM part)
SELECT p_partkey, label, substr('gap:app:' || regexp_replace(lower(label), '\s+', '_', 'g'), 1, 200) AS slug FROM l
"""


def code_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module, card and content hash of parts as files below src."""
    p = load(spark, sf_dir, "part").withColumn("dir", F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), F.col("p_size").cast("string"), F.lit("/deep"))).otherwise("")))
    p = p.withColumn("module", T.module_of(F.col("dir"))).withColumn("symbol", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, ""))
    return p.select("p_partkey", "module", T.card(F.col("dir"), F.col("module"), F.col("symbol")).alias("card"), T.content_hash(F.concat("dir", "p_name")).alias("hash"))


CARD_SQL = """
WITH d AS (SELECT *, 'src/' || lower(replace(p_brand, '#', '')) || CASE WHEN p_size % 2 = 0 THEN '/' || p_size || '/deep' ELSE '' END AS dir, lower(replace(p_brand, '#', '')) || CASE WHEN p_size % 2 = 0 THEN '/' || p_size ELSE '' END AS module FROM part)
SELECT p_partkey, module, dir || ' · ' || module || CASE WHEN p_size % 3 = 0 AND p_type <> '' THEN ' · ' || p_type ELSE '' END AS card, substr(sha256(dir || p_name), 1, 16) AS hash FROM d
"""


def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended by type, then one user's rows replaced, in one store; a failed commit of two tables between changes nothing."""
    root = f"{shared_dir(spark)}/store-{spark._jvm.java.util.UUID.randomUUID()}"
    store, runs = Store(spark, root), Runs(spark, root)
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for kind in ("view", "click", "error"):
        with runs.run(kind):
            store.append("events", ev.where(F.col("event_type") == kind))
    try:
        with runs.run("broken"):
            store.commit_all({"events": ev, "other": ev.select(F.expr("if(event_id >= 0, raise_error('stop'), event_id)").alias("x"))})
    except Exception:  # noqa: BLE001, S110
        pass
    store.replace_where("events", F.col("user_id") % 7 == 0, ev.where("user_id % 7 = 0 and event_type = 'signup'"))
    rows = store.read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
    return rows.unionByName(runs.table().groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("runs "), "status").alias("event_type"), "n", F.lit(None).cast("long").alias("total")))


STORE_SQL = """
SELECT event_type, count(*) AS n, sum(event_id)::bigint AS total FROM events WHERE (event_type IN ('view', 'click', 'error') AND user_id % 7 <> 0) OR (event_type = 'signup' AND user_id % 7 = 0) GROUP BY 1
UNION ALL SELECT 'runs done', 3, NULL UNION ALL SELECT 'runs failed', 1, NULL
"""


def queue_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as reviews in a queue, their events as reasons."""
    return R.queue_report(load(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("reason")))


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to users' groups, by kind: opened, joined, told that it is gone, merged."""
    how = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "purchase", "resolution").otherwise("embedding")
    assigned = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("group_id"), how.alias("matched_by"), F.col("event_id").cast("string").alias("review_id"))
    keep = assigned.select(F.col("group_id").alias("id")).distinct().withColumn("keep", F.when(F.col("id").cast("long") % 5 == 0, "0").otherwise(F.col("id")))
    return G.events(assigned, keep).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("n_groups"), F.count("review_id").alias("n_reviews"))


SIGNAL_EVENTS_SQL = """
WITH e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'purchase' THEN 'STATUS_CHANGED' ELSE 'MEMBER_ADDED' END AS k, 1 AS r FROM events UNION ALL SELECT DISTINCT user_id, 'MERGED', NULL FROM events WHERE user_id % 5 = 0 AND user_id <> 0)
SELECT k AS event_type, count(*) AS n, count(DISTINCT user_id) AS n_groups, count(r) AS n_reviews FROM e GROUP BY 1
"""

_ALL = (validated_reviews, module_overview, feature_listing, artifact_overlap, decisions_taken, confidence_bands, gap_slugs, code_cards, store_versions, queue_by_reason, signal_events)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "validated_reviews": VALID_SQL, "artifact_overlap": OVERLAP_SQL, "decisions_taken": DECIDE_SQL, "gap_slugs": SLUG_SQL, "code_cards": CARD_SQL, "store_versions": STORE_SQL, "signal_events": SIGNAL_EVENTS_SQL,
    "module_overview": "SELECT p_brand AS module, count(*) FILTER (WHERE p_partkey % 3 = 0) AS files, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS symbols, max(CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_size > 40 THEN 3 WHEN p_size > 30 THEN 2 WHEN p_size > 10 THEN 1 ELSE 0 END END) AS risk_rank FROM part GROUP BY 1",
    "feature_listing": "SELECT s_suppkey AS id, 'S' || s_nationkey AS label FROM supplier ORDER BY label, id LIMIT 90",
    "confidence_bands": "SELECT event_type, count(*) FILTER (WHERE value / 100 >= 0.6 AND value / 100 < 0.85) AS n_low, count(*) AS n FROM events GROUP BY 1",
    "queue_by_reason": "SELECT event_type AS reason, count(DISTINCT user_id) AS n_reviews FROM events GROUP BY 1",
}
