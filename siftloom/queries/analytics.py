"""Queries of joins, aggregates, scores and read models; driver tables stand in for reviews and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import analytics as A
from ..sources.tables import load

NOW = "2024-01-31 00:00:00"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are modules, nations their features."""
    r, n = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    return r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label")).unionByName(
        n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"))
    )


_FEATURES = "f AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation)"


def module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.module_map(_features(spark, sf_dir)).select("module", F.array_join("features", ",").alias("features"))


def parent_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_parent(_features(spark, sf_dir)).select("id", "path")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers are artifacts of modules; line items are calls, low ones imports."""
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("module"), F.concat(F.lit("f"), F.col("p_partkey") % 97).alias("path"), F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 25, "high").otherwise("low").alias("risk_tier"), F.col("p_size").alias("risk_score"))
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("module"), F.concat(F.lit("g"), "s_suppkey").alias("path"), F.lit("low").alias("risk_tier"), F.lit(1).alias("risk_score"))
    e = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.when(F.col("l_linenumber") <= 1, "imports").otherwise("calls").alias("kind"))
    return e, p.unionByName(s)


_GRAPH = """
art AS (SELECT 'p' || p_partkey AS id, p_brand AS module, 'f' || (p_partkey % 97) AS path, CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 25 THEN 'high' ELSE 'low' END AS risk_tier, p_size AS risk_score FROM part
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'g' || s_suppkey, 'low', 1 FROM supplier),
e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE WHEN l_linenumber <= 1 THEN 'imports' ELSE 'calls' END AS kind FROM lineitem)"""


def module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.module_imports(*_graph(spark, sf_dir)).select("module", F.array_join("imports", ",").alias("imports"))


def module_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.module_blast(*_graph(spark, sf_dir))


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.blast_radius(*_graph(spark, sf_dir)).select("id", "callers", "risk_tier")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items report on parts (groups); orders give severity and time, customers the author."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.split("o_orderpriority", "-")[0].alias("prio"))
    sev = F.when(F.col("prio") == "1", "critical").when(F.col("prio") == "2", "high").when(F.col("prio") == "3", "medium").otherwise("low")
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("l_partkey").alias("group_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), F.col("o_orderdate").alias("created_at"), sev.alias("severity"), F.col("l_suppkey").alias("feature_id"), F.col("l_returnflag").alias("app_version"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("author_id"), F.when(F.col("o_custkey") % 14 == 0, F.concat(F.lit("name"), F.col("o_custkey") % 50)).alias("author_name"),
    )


_MEMBERS = """
m AS (SELECT l_partkey AS group_id, l_orderkey * 10 + l_linenumber AS review_id, o_orderdate AS created_at, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
  l_suppkey AS feature_id, l_returnflag AS app_version, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey::varchar END AS author_id, CASE WHEN o_custkey % 14 = 0 THEN 'name' || (o_custkey % 50) END AS author_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def bug_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.group_summary(_members(spark, sf_dir))
    return g.select("group_id", "corroboration", "severity", "feature_id", F.array_join("versions", ",").alias("versions"))


def samples_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_samples(_members(spark, sf_dir)).select("group_id", "rank", "review_id")


def demand_distinct_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are features; every fifth was merged into the one before it."""
    reports = _members(spark, sf_dir).withColumn("source_id", F.col("review_id").cast("string"))
    f = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when((F.col("s_suppkey") % 5 == 0) & (F.col("s_suppkey") > 0), F.col("s_suppkey") - 1).alias("merged_into"))
    return A.demand(reports, f)


def lateral_top_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest part of every order."""
    groups = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.collect_set("l_partkey").alias("artifact_ids"))
    return A.top_risk(groups, load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("risk_score")))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("is_defect"), (F.col("event_type") == "purchase").alias("is_resolution"))


_REPORTS = "r AS (SELECT user_id AS group_id, ts, event_type = 'error' AS is_defect, event_type = 'purchase' AS is_resolution FROM events)"
_TREND = "CASE WHEN n_times <= 1 THEN 'new' WHEN recent = 0 THEN 'declining' WHEN prior = 0 THEN 'rising' WHEN recent > prior THEN 'rising' WHEN recent < prior THEN 'declining' ELSE 'stable' END"
_TRENDS = f"""
tr AS (SELECT group_id, n_times, recent, prior, {_TREND} AS trend FROM (SELECT group_id, count(ts) AS n_times, count(*) FILTER (WHERE epoch(TIMESTAMP '{NOW}') - epoch(ts) <= 1209600) AS recent,
  count(*) FILTER (WHERE epoch(TIMESTAMP '{NOW}') - epoch(ts) > 1209600 AND epoch(TIMESTAMP '{NOW}') - epoch(ts) <= 2419200) AS prior FROM r WHERE is_defect GROUP BY group_id))"""
_STATS = """
la AS (SELECT group_id, count(*) AS resolved, max(ts) AS last FROM r WHERE is_resolution GROUP BY group_id), si AS (SELECT group_id, count(*) AS since FROM r JOIN la USING (group_id) WHERE is_defect AND ts > last GROUP BY group_id),
st AS (SELECT group_id, n AS corroboration, coalesce(resolved, 0) AS resolved, coalesce(since, 0) AS since FROM (SELECT group_id, count(*) AS n FROM r WHERE is_defect GROUP BY group_id) LEFT JOIN la USING (group_id) LEFT JOIN si USING (group_id))"""


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trends(_reports(spark, sf_dir).where("is_defect"), _now())


def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    t = A.trends(r.where("is_defect"), _now()).select("group_id", "trend")
    s = A.resolution_stats(r).join(t, "group_id")
    d = S.suppression(F.col("resolved"), F.col("since"), F.col("trend"), F.col("corroboration"))
    return s.select("group_id", "corroboration", "resolved", "since", d["suppress"].alias("suppress"), d["reason"].alias("reason"))


SUPPRESSION_SQL = f"""
WITH {_REPORTS}, {_TRENDS}, {_STATS}, x AS (SELECT *, CASE WHEN corroboration >= 5 THEN 1 ELSE 0 END AS tol FROM st JOIN tr USING (group_id))
SELECT group_id, corroboration, resolved, since, resolved > 0 AND since <= tol AS suppress,
  CASE WHEN resolved <= 0 THEN 'no resolution report — proposal stands' WHEN since > tol THEN 'regression: ' || since || ' new defect report(s) after resolution (tolerance ' || tol || ') — resurface'
  ELSE 'resolved by ' || resolved || ' report(s), no regression' || CASE WHEN since > 0 THEN ' (' || since || ' late report within tolerance ' || tol || ')' ELSE '' END || CASE WHEN trend = 'declining' THEN ' (trend declining — confirms fade)' ELSE '' END END AS reason FROM x
"""

_KINDS, _VERDICTS = ("bug_fix", "feature_gap", "enhancement"), ("grounded", "partial", "ungrounded")


def impact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact, band, risk and effort of a proposal per user with reports."""
    r = _reports(spark, sf_dir).where("is_defect")
    t = A.trends(r, _now())
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    g = F.col("group_id")
    t = t.select("group_id", "trend", F.col("n_times").alias("n"), pick(_KINDS, g).alias("kind"), (g % 4 + 1).cast("int").alias("severity"), S.effective_risk(pick(("low", "medium", "high", "critical"), F.floor(g / 3)), F.col("recent")).alias("risk"), pick(_VERDICTS, F.floor(g / 7)).alias("verdict"))
    t = t.withColumn("score", S.impact(F.col("kind"), F.col("n"), F.col("severity"), F.col("risk"), F.col("verdict"), F.col("trend")))
    e = S.effort(F.col("kind"), F.col("n"), g % 2 == 0, F.floor(g % 11))
    return t.select("group_id", "kind", "risk", "score", S.band(F.col("score")).alias("band"), e["size"].alias("size"), e["weeks"].alias("weeks"), e["rationale"].alias("rationale"))


_CASE = lambda key, values, default="": f"CASE {key} " + " ".join(f"WHEN {repr(k)} THEN {v}" for k, v in values.items()) + f" {default} END"
IMPACT_SQL = f"""
WITH {_REPORTS}, {_TRENDS}, a AS (
  SELECT group_id, trend, n_times AS n, recent, ['bug_fix', 'feature_gap', 'enhancement'][group_id % 3 + 1] AS kind, group_id % 4 + 1 AS severity, (group_id // 3) % 4 AS tier, CASE WHEN recent >= 8 THEN 3 WHEN recent >= 4 THEN 2 WHEN recent >= 2 THEN 1 ELSE 0 END AS blast,
    ['grounded', 'partial', 'ungrounded'][(group_id // 7) % 3 + 1] AS verdict FROM tr
), b AS (
  SELECT *, ['low', 'medium', 'high', 'critical'][greatest(tier, blast) + 1] AS risk, 1 - exp(-n / 4.0::double) AS ev FROM a
), c AS (
  SELECT *, floor(100 * ev * (CASE kind WHEN 'bug_fix' THEN 0.6::double * (severity * 0.25::double) + 0.4::double * {_CASE("risk", S.RISK_VALUE)}::double WHEN 'feature_gap' THEN 0.7::double ELSE 0.45::double END)
    * (CASE WHEN kind = 'feature_gap' THEN {_CASE("verdict", S.VERDICT_CONFIDENCE)}::double ELSE 1.0 END) * {_CASE("trend", S.MOMENTUM)}::double * 100 + 0.5) / 100 AS score,
    CASE WHEN kind = 'feature_gap' THEN 1 ELSE 0 END AS base, CASE WHEN kind = 'feature_gap' AND group_id % 2 = 0 THEN 2 ELSE 0 END AS fresh, CASE WHEN n >= 5 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS spans, CASE WHEN group_id % 11 >= 8 THEN 2 WHEN group_id % 11 >= 3 THEN 1 ELSE 0 END AS cares FROM b
), d AS (SELECT *, ['S', 'M', 'L', 'XL'][least(3, base + fresh + spans + cares) + 1] AS size FROM c)
SELECT group_id, kind, risk, score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS band, size, CASE size WHEN 'S' THEN '~3 days' WHEN 'M' THEN '1–2 wks' WHEN 'L' THEN '2–4 wks' ELSE '4+ wks' END AS weeks,
  kind || ' base ' || ['S', 'M'][base + 1] || CASE WHEN fresh > 0 THEN ', new module (+2)' ELSE '' END || CASE WHEN spans > 0 THEN ', spans ' || n || ' modules (+' || spans || ')' ELSE '' END || CASE WHEN cares > 0 THEN ', blast-radius ' || (group_id % 11) || ' (+' || cares || ')' ELSE '' END AS rationale FROM d
"""


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user: whether an error came after the last purchase, as stale proposals are told."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("p"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("q"))
    return e.select("user_id", S.proposals_stale(F.col("p"), F.col("q")).alias("stale"))


def _distribution(spark: SparkSession, sf_dir: str, cond: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").where(cond)
    cells = F.array(F.struct(F.lit("event_type").alias("dimension"), F.col("event_type").alias("bucket")), F.struct(F.lit("value").alias("dimension"), F.least(F.floor(F.col("value") / 20), F.lit(9)).cast("string").alias("bucket")))
    return ev.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.bucket").agg(F.count("*").alias("n"))


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distribution(spark, sf_dir, "true")


def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the first against the second half of the events."""
    return A.psi(_distribution(spark, sf_dir, "ts < '2024-01-08'"), _distribution(spark, sf_dir, "ts >= '2024-01-08'"))


_DIST = "SELECT 'event_type' AS dimension, event_type AS bucket, count(*) AS n FROM events WHERE {0} GROUP BY 2 UNION ALL SELECT 'value', least(floor(value / 20), 9)::bigint::varchar, count(*) FROM events WHERE {0} GROUP BY 2"
PSI_SQL = f"""
WITH a AS ({_DIST.format("ts < '2024-01-08'")}), b AS ({_DIST.format("ts >= '2024-01-08'")}),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY dimension) AS p FROM a), q AS (SELECT *, n / sum(n) OVER (PARTITION BY dimension) AS q FROM b),
j AS (SELECT coalesce(p.dimension, q.dimension) AS dimension, greatest(coalesce(p, 0), 1e-6)::double AS p, greatest(coalesce(q, 0), 1e-6)::double AS q FROM p FULL JOIN q ON p.dimension = q.dimension AND p.bucket = q.bucket),
s AS (SELECT dimension, floor(sum((q - p) * ln(q / p)) * 1000 + 0.5) / 1000 AS psi FROM j GROUP BY dimension)
SELECT dimension, psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS drift FROM s
"""


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nearest_rank(load(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


PERCENTILES_SQL = """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, len(v) AS n, floor(list_avg(v) * 1000 + 0.5) / 1000 AS mean, v[least(len(v) - 1, floor(0.5 * len(v)))::int + 1] AS p50, v[least(len(v) - 1, floor(0.9 * len(v)))::int + 1] AS p90, v[least(len(v) - 1, floor(0.99 * len(v)))::int + 1] AS p99 FROM s
"""


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, a ratio and the last value of a gauge by user."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))
    return e.select("user_id", "n", A.ratio(F.col("errors"), F.col("n")).alias("error_ratio"), A.ratio(F.col("errors"), F.col("purchases")).alias("errors_per_purchase"), "gauge")


def calibration_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are decided proposals; length gives the band."""
    d = load(spark, sf_dir, "documents").select(F.lit("app").alias("repo"), F.col("source").alias("kind"), F.col("doc_id").alias("ref_id"), F.when(F.col("n_chars") > 4000, "high").when(F.col("n_chars") > 1000, "medium").when(F.col("n_chars") > 100, "low").alias("band"))
    x = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    x = x.select(F.lit("app").alias("repo"), F.col("source").alias("kind"), F.col("doc_id").alias("ref_id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"))
    return A.decisions_by_band(d, x)


CALIBRATION_SQL = """
WITH j AS (SELECT CASE WHEN n_chars > 4000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' WHEN n_chars > 100 THEN 'low' ELSE 'unknown' END AS band, quality FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT band, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS approved, count(*) FILTER (WHERE quality <> 1) AS rejected FROM j GROUP BY band)
SELECT *, CASE WHEN approved + rejected > 0 THEN floor(approved * 1000.0::double / (approved + rejected) + 0.5) / 10 END AS approval_pct FROM c
"""


def gap_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements checked against the real modules, named in structure or in text."""
    plans = load(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 5 == 0, "new_module").otherwise("existing_module").alias("placement"), F.element_at(F.array(*map(F.lit, ("app/checkout", "lib", "app/ghost"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("module"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("app/auth/"), F.when(F.col("p_partkey") % 4 == 0, "app/unknown").otherwise("lib"))).otherwise(F.array().cast("array<string>")).alias("connections"), F.when(F.col("p_partkey") % 7 == 0, "see `app/nowhere` and app/auth").otherwise("uses components/cart").alias("body"),
    )
    modules = F.array(*map(F.lit, ("app/checkout", "app/auth", "components/cart", "lib")))
    v = S.gap_verdict(F.col("placement"), F.col("module"), F.lit(""), F.col("body"), F.col("connections"), modules)
    return plans.groupBy(v["verdict"].alias("verdict"), F.array_join(v["invented"], ",").alias("invented")).agg(F.count("*").alias("n"))


GAP_SQL = """
WITH a AS (SELECT p_partkey AS k, ['app/checkout', 'lib', 'app/ghost'][p_partkey % 3 + 1] AS module FROM part),
b AS (SELECT *, k % 5 = 0 OR module <> 'app/ghost' AS ok, CASE WHEN k % 2 = 0 AND k % 4 = 0 THEN 'app/unknown' WHEN k % 2 <> 0 AND k % 7 = 0 THEN 'app/nowhere' ELSE '' END AS invented FROM a)
SELECT CASE WHEN NOT ok THEN 'ungrounded' WHEN invented <> '' THEN 'partial' ELSE 'grounded' END AS verdict, invented, count(*) AS n FROM b GROUP BY ALL
"""

_ALL = (module_map, parent_label, module_imports, module_blast, blast_radius, bug_groups, samples_top3, demand_distinct_author, lateral_top_risk, trend, suppression, impact_scores, freshness, distributions, psi_drift, percentiles, ratios, calibration_by_band, gap_verdicts)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "module_map": f"WITH {_FEATURES} SELECT p.label AS module, string_agg(DISTINCT c.label, ',' ORDER BY c.label) AS features FROM f p JOIN f c ON c.parent_id = p.id GROUP BY 1",
    "parent_label": f"WITH {_FEATURES} SELECT f.id, CASE WHEN p.label IS NOT NULL THEN p.label || ' › ' || f.label ELSE f.label END AS path FROM f LEFT JOIN f p ON f.parent_id = p.id",
    "module_imports": f"WITH {_GRAPH} SELECT s.module, string_agg(DISTINCT d.module, ',' ORDER BY d.module) AS imports FROM e JOIN art s ON e.src = s.id JOIN art d ON e.dst = d.id WHERE kind = 'imports' AND s.module <> d.module GROUP BY 1",
    "module_blast": f"WITH {_GRAPH} SELECT d.module, count(DISTINCT s.path) AS dependents FROM e JOIN art s ON e.src = s.id JOIN art d ON e.dst = d.id WHERE s.module <> d.module GROUP BY 1",
    "blast_radius": f"WITH {_GRAPH} SELECT id, count(DISTINCT src) AS callers, any_value(risk_tier) AS risk_tier FROM e JOIN art ON dst = id WHERE kind = 'calls' GROUP BY id ORDER BY callers DESC, CASE any_value(risk_tier) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, id LIMIT 20",
    "bug_groups": f"WITH {_MEMBERS} SELECT group_id, count(*) AS corroboration, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity, arg_min(feature_id, (created_at, review_id)) AS feature_id, string_agg(DISTINCT app_version, ',' ORDER BY app_version) AS versions FROM m GROUP BY group_id",
    "samples_top3": f"WITH {_MEMBERS}, r AS (SELECT group_id, (row_number() OVER (PARTITION BY group_id ORDER BY created_at, review_id))::int AS rank, review_id FROM m) SELECT * FROM r WHERE rank <= 3",
    "demand_distinct_author": f"WITH {_MEMBERS}, f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey > 0 THEN s_suppkey - 1 END AS merged FROM supplier) SELECT c.id AS canon, count(DISTINCT CASE WHEN m.review_id IS NOT NULL THEN coalesce(author_id, author_name, review_id::varchar) END) AS demand FROM f c LEFT JOIN f x ON coalesce(x.merged, x.id) = c.id LEFT JOIN m ON m.feature_id = x.id WHERE c.merged IS NULL GROUP BY c.id",
    "lateral_top_risk": "SELECT l_orderkey AS group_id, arg_max(p_partkey, (p_size, p_partkey)) AS artifact FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "trend": f"WITH {_REPORTS}, {_TRENDS} SELECT * FROM tr",
    "suppression": SUPPRESSION_SQL, "impact_scores": IMPACT_SQL,
    "freshness": "WITH g AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'error') AS p, max(ts) FILTER (WHERE event_type = 'purchase') AS q FROM events GROUP BY user_id) SELECT user_id, CASE WHEN p IS NULL THEN false WHEN q IS NULL THEN true ELSE p > q END AS stale FROM g",
    "distributions": _DIST.format("true"), "psi_drift": PSI_SQL, "percentiles": PERCENTILES_SQL,
    "ratios": "WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'purchase') AS p, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY user_id) SELECT user_id, n, CASE WHEN n = 0 THEN 0 ELSE floor(e / n * 1000 + 0.5) / 1000 END AS error_ratio, CASE WHEN p = 0 THEN 0 ELSE floor(e / p * 1000 + 0.5) / 1000 END AS errors_per_purchase, gauge FROM g",
    "calibration_by_band": CALIBRATION_SQL, "gap_verdicts": GAP_SQL,
}
