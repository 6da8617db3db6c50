"""Queries of proposals, groups kept over time and read models; driver tables stand in for reviews and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import scoring as S
from ..functions import text as T
from ..operators import analytics as A
from ..operators import insight as I
from ..operators import reviews as R
from ..operators import signals as G
from ..sources.tables import load
from . import analytics as Q
from . import texts as X

NOW = "1998-07-01 00:00:00"
REPO = "app"


def _now():
    return F.lit(NOW).cast("timestamp")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are reports on parts; returned ones say that the defect is gone."""
    m = Q._members(spark, sf_dir)
    return m.withColumn("ts", F.col("created_at").cast("timestamp")).withColumn("is_defect", F.col("app_version") != "R").withColumn("is_resolution", F.col("app_version") == "R")


_REPORTS = f"{Q._MEMBERS}, r AS (SELECT *, created_at AS ts, app_version <> 'R' AS is_defect, app_version = 'R' AS is_resolution FROM m)"
_TRENDS = Q._TRENDS.replace(Q.NOW, NOW)
_BAND = "CASE WHEN priority >= 75 THEN 'critical' WHEN priority >= 50 THEN 'high' WHEN priority >= 25 THEN 'medium' ELSE 'low' END"


def _bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    members = r.where("is_defect").withColumn("text", F.concat(F.lit("report "), F.col("review_id").cast("string"))).withColumn("artifact_ids", F.array(F.concat(F.lit("p"), F.col("group_id").cast("string")), F.concat(F.lit("p"), (F.col("group_id") % 50 + 1).cast("string"))))
    edges, artifacts = Q._graph(spark, sf_dir)
    return I.bug_proposals(members, r, artifacts, A.module_blast(edges, artifacts), _now(), REPO)


def bug_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal per part with reports: score, effort, target and whether it rests."""
    return _bugs(spark, sf_dir).select(*I.PROPOSAL)


_BUGS = f"""{_REPORTS}, {_TRENDS}, {Q._STATS}, {Q._GRAPH},
bl AS (SELECT d.module, count(DISTINCT s.path) AS n_dep FROM e JOIN art s ON e.src = s.id JOIN art d ON e.dst = d.id WHERE s.module <> d.module GROUP BY 1),
gs AS (SELECT group_id, count(*) AS corroboration, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity, arg_min(feature_id, (created_at, review_id)) AS feature_id FROM r WHERE is_defect GROUP BY group_id),
tx AS (SELECT group_id, string_agg('- report ' || review_id, chr(10) ORDER BY created_at, review_id) AS body FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY created_at, review_id) AS k FROM r WHERE is_defect) WHERE k <= 3 GROUP BY 1),
tp AS (SELECT group_id, arg_max(id, (risk_score, id)) AS id FROM (SELECT DISTINCT group_id, unnest(['p' || group_id, 'p' || (group_id % 50 + 1)]) AS id FROM gs) JOIN art USING (id) GROUP BY 1),
b1 AS (SELECT gs.*, body, module, trend, coalesce(n_dep, 0) AS n_dep, coalesce(resolved, 0) AS resolved, coalesce(since, 0) AS since, CASE risk_tier WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS tier,
  CASE WHEN gs.corroboration >= 5 THEN 1 ELSE 0 END AS tol FROM gs JOIN tx USING (group_id) LEFT JOIN tp USING (group_id) LEFT JOIN art USING (id) LEFT JOIN bl USING (module) LEFT JOIN st USING (group_id) LEFT JOIN tr USING (group_id)),
b2 AS (SELECT *, ['low', 'medium', 'high', 'critical'][greatest(tier, CASE WHEN n_dep >= 8 THEN 3 WHEN n_dep >= 4 THEN 2 WHEN n_dep >= 2 THEN 1 ELSE 0 END) + 1] AS risk FROM b1),
b3 AS (SELECT *, floor(100 * (1 - exp(-corroboration / {float(S.EVIDENCE_HALF)}::double)) * (0.6::double * (severity * 0.25::double) + 0.4::double * {Q._CASE("risk", S.RISK_VALUE)}::double) * {Q._CASE("trend", S.MOMENTUM)}::double * 100 + 0.5) / 100 AS priority FROM b2),
bugs AS (SELECT '{REPO}' AS repo, 'bug_fix' AS kind, group_id::varchar AS ref_id, '[bug] ' || feature_id || ' ×' || corroboration AS title, body, priority, {_BAND} AS band, CASE WHEN n_dep >= 8 THEN 'L' WHEN n_dep >= 3 THEN 'M' ELSE 'S' END AS effort, module AS target_module, NULL::varchar AS placement,
  resolved > 0 AND since <= tol AS suppressed, CASE WHEN resolved <= 0 THEN 'no resolution report — proposal stands' WHEN since > tol THEN 'regression: ' || since || ' new defect report(s) after resolution (tolerance ' || tol || ') — resurface'
  ELSE 'resolved by ' || resolved || ' report(s), no regression' || CASE WHEN since > 0 THEN ' (' || since || ' late report within tolerance ' || tol || ')' ELSE '' END || CASE WHEN trend = 'declining' THEN ' (trend declining — confirms fade)' ELSE '' END END AS reason, feature_id FROM b3)"""
_COLUMNS = ", ".join(I.PROPOSAL)


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are modules, the first words of their parts' types features."""
    return load(spark, sf_dir, "part").groupBy(F.concat(F.lit("app/"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("module")).agg(A.listed(F.split("p_type", " ")[0]).alias("features"))


_WISHES = ("economy export", "standard view", "zzqx", "promo list of all", "brand12 page", "qqwv kkz")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are wishes; every fifth was merged into the one before it."""
    k = F.col("s_suppkey")
    label = F.element_at(F.array(*map(F.lit, _WISHES)), (k % len(_WISHES) + 1).cast("int"))
    f = load(spark, sf_dir, "supplier").select(F.concat(F.lit("g"), k.cast("string")).alias("id"), F.when((k % 5 == 0) & (k > 0), F.concat(F.lit("g"), (k - 1).cast("string"))).alias("merged_into"), label.alias("label"), F.concat(F.lit("asked for by "), k.cast("string")).alias("description"))
    r = _reports(spark, sf_dir).withColumn("feature_id", F.concat(F.lit("g"), F.col("feature_id").cast("string"))).withColumn("source_id", F.col("review_id").cast("string"))
    return I.gap_proposals(r, f, _modules(spark, sf_dir), _now(), REPO)


def gap_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal per wish, merged ones counted with the one they went into, placed where words agree."""
    return _gaps(spark, sf_dir).select(*I.PROPOSAL)


_DEMAND = "count(DISTINCT coalesce(author_id, author_name, review_id::varchar))"
_GAPS = f"""
gf AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey > 0 THEN s_suppkey - 1 END AS merged, [{", ".join(f"'{w}'" for w in _WISHES)}][s_suppkey % {len(_WISHES)} + 1] AS label, 'asked for by ' || s_suppkey AS description FROM supplier),
gr AS (SELECT coalesce(merged, k) AS canon, r.* FROM r JOIN gf ON feature_id = k),
gd AS (SELECT canon, {_DEMAND} AS demand, count(ts) AS n_times, count(*) FILTER (WHERE epoch(TIMESTAMP '{NOW}') - epoch(ts) <= 1209600) AS recent, count(*) FILTER (WHERE epoch(TIMESTAMP '{NOW}') - epoch(ts) > 1209600 AND epoch(TIMESTAMP '{NOW}') - epoch(ts) <= 2419200) AS prior FROM gr GROUP BY 1),
gm AS (SELECT 'app/' || lower(replace(p_brand, '#', '')) AS module, lower('app/' || lower(replace(p_brand, '#', '')) || ' ' || string_agg(DISTINCT split_part(p_type, ' ', 1), ' ')) AS hay FROM part GROUP BY p_brand),
gh AS (SELECT DISTINCT k, h FROM (SELECT k, unnest(string_split_regex(lower(label || ' ' || description), '[^a-z가-힣0-9]+')) AS h FROM gf WHERE merged IS NULL) WHERE length(h) >= 2),
gp AS (SELECT k, arg_max(module, (score, module)) AS module FROM (SELECT k, module, count(*) AS score FROM gh JOIN gm ON contains(hay, h) GROUP BY ALL) GROUP BY k),
gg AS (SELECT gf.*, module, coalesce(demand, 0) AS demand, CASE WHEN n_times IS NULL THEN 'new' ELSE {Q._TREND} END AS trend FROM gf LEFT JOIN gd ON canon = k LEFT JOIN gp USING (k) WHERE merged IS NULL),
gs2 AS (SELECT *, floor(100 * (1 - exp(-demand / {float(S.EVIDENCE_HALF)}::double)) * {S.GAP_VALUE}::double * {S.VERDICT_CONFIDENCE["grounded"]}::double * {Q._CASE("trend", S.MOMENTUM)}::double * 100 + 0.5) / 100 AS priority FROM gg),
gaps AS (SELECT '{REPO}' AS repo, 'feature_gap' AS kind, 'g' || k AS ref_id, '[feature] ' || label AS title, description AS body, priority, {_BAND} AS band, CASE WHEN module IS NULL THEN 'XL' ELSE 'L' END AS effort, coalesce(module, regexp_replace(label, '\\s+', '', 'g') || 'Module(신규)') AS target_module,
  CASE WHEN module IS NULL THEN 'new_module' ELSE 'existing_module' END AS placement, false AS suppressed, 'grounded' AS reason FROM gs2)"""


def _wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = _bugs(spark, sf_dir)
    first = A.group_summary(_reports(spark, sf_dir).where("is_defect")).select(F.col("group_id").cast("string").alias("ref_id"), F.concat(F.lit("s"), F.col("feature_id").cast("string")).alias("feature_id"))
    f = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("module"), F.lit(None).cast("string").alias("merged_into"))
    r = _reports(spark, sf_dir).where("severity = 'low'").withColumn("feature_id", F.concat(F.lit("s"), F.col("feature_id").cast("string"))).withColumn("source_id", F.col("review_id").cast("string"))
    return I.enhancement_proposals(r, f, bugs.join(first, "ref_id"), _now(), REPO)


def enhancement_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal per supplier that reports of low severity are on, told of open bugs."""
    return _wishes(spark, sf_dir).select(*I.PROPOSAL)


_ENHANCE = f"""
ed AS (SELECT feature_id AS k, {_DEMAND} AS demand, count(ts) AS n_times, count(*) FILTER (WHERE epoch(TIMESTAMP '{NOW}') - epoch(ts) <= 1209600) AS recent, count(*) FILTER (WHERE epoch(TIMESTAMP '{NOW}') - epoch(ts) > 1209600 AND epoch(TIMESTAMP '{NOW}') - epoch(ts) <= 2419200) AS prior FROM r WHERE severity = 'low' GROUP BY 1),
es AS (SELECT *, {Q._TREND} AS trend FROM ed JOIN supplier ON s_suppkey = k),
ep AS (SELECT *, floor(100 * (1 - exp(-demand / {float(S.EVIDENCE_HALF)}::double)) * {S.ENHANCEMENT_VALUE}::double * {Q._CASE("trend", S.MOMENTUM)}::double * 100 + 0.5) / 100 AS priority FROM es),
enh AS (SELECT '{REPO}' AS repo, 'enhancement' AS kind, 's' || k AS ref_id, '[improve] ' || s_name AS title, CASE WHEN k IN (SELECT feature_id FROM bugs WHERE NOT suppressed) THEN 'related bug' ELSE '' END AS body, priority, {_BAND} AS band, 'S' AS effort, 'n' || s_nationkey AS target_module,
  'existing_module' AS placement, false AS suppressed, NULL::varchar AS reason FROM ep)"""


def ranked_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All proposals that stand, on one scale, with what people decided on every third one, by the newest report."""
    top = I.ranked(_bugs(spark, sf_dir), _gaps(spark, sf_dir), _wishes(spark, sf_dir))
    decisions = load(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.lit(REPO).alias("repo"), F.lit("bug_fix").alias("kind"), F.col("p_partkey").cast("string").alias("ref_id"), F.when(F.col("p_partkey") % 2 == 0, "approved").otherwise("rejected").alias("decision"))
    out = I.with_decisions(top, decisions, _now(), F.lit("1998-06-01").cast("timestamp"))
    return out.select("kind", "ref_id", "priority", "band", "decision", "stale")


RANKED_SQL = f"""
WITH {_BUGS}, {_GAPS}, {_ENHANCE}, a AS (SELECT {_COLUMNS} FROM bugs UNION ALL SELECT {_COLUMNS} FROM gaps UNION ALL SELECT {_COLUMNS} FROM enh)
SELECT kind, ref_id, priority, band, CASE WHEN kind = 'bug_fix' AND ref_id::int % 3 = 0 THEN CASE WHEN ref_id::int % 2 = 0 THEN 'approved' ELSE 'rejected' END ELSE 'pending' END AS decision, true AS stale FROM a WHERE NOT suppressed
"""


def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders merged into the order of their customer and status that came first, recomputed from members."""
    o = load(spark, sf_dir, "orders")
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    groups = o.join(l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("artifacts")), "o_orderkey").select(F.col("o_orderkey").alias("id"), "artifacts", F.col("o_orderdate").alias("first_seen"))
    first = o.groupBy("o_custkey", "o_orderstatus").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("keep"))
    keep = o.join(first, ["o_custkey", "o_orderstatus"]).select(F.col("o_orderkey").alias("id"), "keep")
    members = l.select(F.col("l_orderkey").alias("group_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), F.col("l_returnflag").alias("app_version"), F.col("l_linestatus").alias("platform"))
    out = G.merged(groups, members, keep)
    return out.select("group_id", "corroboration", F.array_join("versions", ",").alias("versions"), F.array_join("platforms", ",").alias("platforms"), F.size("artifacts").alias("n_artifacts"), "first_seen")


MERGED_SQL = """
WITH k AS (SELECT o_orderkey AS id, o_orderdate, arg_min(o_orderkey, (o_orderdate, o_orderkey)) OVER (PARTITION BY o_custkey, o_orderstatus) AS keep FROM orders)
SELECT keep AS group_id, count(DISTINCT l_orderkey * 10 + l_linenumber) AS corroboration, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS versions, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS platforms, count(DISTINCT l_partkey)::int AS n_artifacts, min(o_orderdate) AS first_seen
FROM k JOIN lineitem ON l_orderkey = id GROUP BY 1
"""


def group_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of vectors as groups: the even vectors came first, the odd ones join them."""
    v = load(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("label").alias("group_id"), F.col("vec_id").alias("review_id"), F.timestamp_seconds(F.col("vec_id") * 60).alias("created_at"), F.concat(F.lit("v"), F.col("vec_id") % 7).alias("app_version"), F.lit("web").alias("platform"), F.col("embedding").alias("v"))
    old = v.where("review_id % 2 = 0")
    groups = old.groupBy("group_id").agg(F.min_by("v", "review_id").alias("vector"), F.count("*").alias("corroboration"), A.listed(F.col("app_version")).alias("versions"), A.listed(F.col("platform")).alias("platforms"), F.max("created_at").alias("last_seen"), F.lit(0.0).alias("max_radius"), F.lit(0).cast("long").alias("resolution_count"))
    groups = G.with_members(groups, v.where("review_id % 2 = 1"))
    solved = v.where("review_id % 10 = 3").select("group_id", "review_id")
    return G.with_resolutions(groups, solved).select("group_id", "corroboration", F.array_join("versions", ",").alias("versions"), "last_seen", T.rounded(F.col("max_radius"), 4).alias("max_radius"), "resolution_count")


UPDATES_SQL = """
WITH v AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings WHERE embedding IS NOT NULL), f AS (SELECT label, arg_min(v, vec_id) AS rep FROM v WHERE vec_id % 2 = 0 GROUP BY label)
SELECT label AS group_id, count(*) AS corroboration, string_agg(DISTINCT 'v' || (vec_id % 7), ',' ORDER BY 'v' || (vec_id % 7)) AS versions, max(make_timestamp(vec_id * 60000000)) AS last_seen,
  floor(greatest(0, coalesce(max(1 - list_cosine_similarity(v, rep)) FILTER (WHERE vec_id % 2 = 1), 0)) * 10000 + 0.5) / 10000 AS max_radius, count(*) FILTER (WHERE vec_id % 10 = 3) AS resolution_count FROM v JOIN f USING (label) GROUP BY label
"""


def mention_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched mentions with their number, times and the ids of their examples, in order of time."""
    ev = load(spark, sf_dir, "events").select(F.concat("event_type", F.lit("  "), F.col("user_id") % 100).alias("mention"), F.col("event_id").alias("review_id"), F.col("ts").cast("timestamp").alias("ts"))
    return A.mention_candidates(ev).select("normalized", "n", "first_seen", "last_seen", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


MENTION_SQL = "SELECT lower(event_type) || ' ' || (user_id % 100) AS normalized, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, array_to_string(list_transform(list(event_id ORDER BY ts, event_id)[1:20], lambda x: x::varchar), ',') AS examples FROM events GROUP BY 1"


def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value that each gauge was set to."""
    return A.gauges(load(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", "ts", "event_id"), ["ts", "event_id"])


def set_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal set at a path of every event's document; what the document held before stays."""
    doc = T.set_json(F.col("props"), "signal", F.struct(F.col("user_id").alias("group_id"), F.col("event_type").alias("matched_by")))
    e = load(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    at = lambda p: F.get_json_object("doc", p)
    return e.select("event_id", at("$.k").alias("k"), at("$.signal.group_id").cast("long").alias("group_id"), at("$.signal.matched_by").alias("matched_by"))


def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified documents with language and the feature they map to, if there is one."""
    rows = X._classified(spark, sf_dir).withColumn("lang", T.detect_language(F.coalesce("text", F.lit("")))).withColumn("feature_id", F.col("doc_id") % 40).withColumn("state", F.when(F.col("doc_id") % 40 < 25, "grounded").otherwise("gap"))
    features = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    return I.review_list(rows.withColumn("source_id", F.col("doc_id").cast("string")), features).select("source_id", "category", "sentiment", "severity", "state", "feature")


REVIEWS_SQL = f"""
WITH {X._CLASSIFIED}
SELECT doc_id::varchar AS source_id, category, sentiment, severity, CASE WHEN doc_id % 40 < 25 THEN 'grounded' ELSE 'gap' END AS state, n_name AS feature FROM c LEFT JOIN nation ON n_nationkey = doc_id % 40
"""


def outdated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be classified or embedded anew after a change of versions, by reason."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("classifier_version"), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("e"), F.col("event_id") % 2)).alias("embedder_version"))
    return R.outdated(e, "c2", "e1").groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


OUTDATED_SQL = """
WITH v AS (SELECT event_id AS id, event_id % 3 <> 2 AS c, coalesce(CASE WHEN event_id % 11 <> 0 THEN event_id % 2 <> 1 END, true) AS e FROM events)
SELECT CASE WHEN c AND e THEN 'both' WHEN c THEN 'classifier' ELSE 'embedder' END AS reason, count(*) AS n, min(id) AS first_id FROM v WHERE c OR e GROUP BY 1
"""


def feature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature graph with its reviews, laid out as a tree."""
    f = Q._features(spark, sf_dir)
    r = load(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("feature_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "defective").otherwise("grounded").alias("state"))
    g = I.feature_graph(f, r)
    return g.join(I.tree_layout(g), "id").select("id", "depth", "n_reviews", "n_defective", "x", "y")


TREE_SQL = f"""
WITH {Q._FEATURES}, n AS (SELECT 'n' || c_nationkey AS id, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS d FROM customer GROUP BY 1),
l AS (SELECT f.id, f.parent_id, (row_number() OVER (ORDER BY p.label || chr(31) || f.label || chr(31) || f.id) - 1) * 58.0::double AS y FROM f JOIN f p ON f.parent_id = p.id),
a AS (SELECT id, 1 AS depth, y FROM l UNION ALL SELECT parent_id, 0, (min(y) + max(y)) / 2 FROM l GROUP BY parent_id)
SELECT a.id, depth, coalesce(n.n, 0) AS n_reviews, coalesce(n.d, 0) AS n_defective, depth * 330 AS x, y FROM a LEFT JOIN n USING (id)
"""

_ALL = (bug_proposals, gap_proposals, enhancement_proposals, ranked_proposals, merged_groups, group_updates, mention_examples, gauge_last, set_signal, review_records, outdated_reviews, feature_tree)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "bug_proposals": f"WITH {_BUGS} SELECT {_COLUMNS} FROM bugs", "gap_proposals": f"WITH {_REPORTS}, {_GAPS} SELECT {_COLUMNS} FROM gaps", "enhancement_proposals": f"WITH {_BUGS}, {_ENHANCE} SELECT {_COLUMNS} FROM enh",
    "ranked_proposals": RANKED_SQL, "merged_groups": MERGED_SQL, "group_updates": UPDATES_SQL, "mention_examples": MENTION_SQL, "review_records": REVIEWS_SQL, "outdated_reviews": OUTDATED_SQL, "feature_tree": TREE_SQL,
    "gauge_last": "SELECT event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
    "set_signal": "SELECT event_id, json_extract_string(props, '$.k') AS k, user_id AS group_id, event_type AS matched_by FROM events",
}
