import pytest
from pyspark.sql import functions as F

from siftloom.functions import scoring as S


def one(spark, c):
    return spark.range(1).select(c.alias("r")).first()[0]


@pytest.mark.parametrize(("ages", "want"), [([], "new"), ([1], "new"), ([1, 2, 3], "rising"), ([40, 45, 50], "declining"), ([1, 2, 20], "rising"), ([2, 18, 20], "declining"), ([2, 5, 18, 22], "stable"), ([-3, 1], "rising")])
def test_trend(spark, ages, want):
    df = spark.createDataFrame([(a,) for a in ages], "a int").select((F.lit("2026-05-26").cast("timestamp") - F.make_dt_interval(F.col("a"))).alias("ts"))
    got = df.agg(*S.window_counts(F.col("ts"), F.lit("2026-05-26").cast("timestamp"))).select(S.trend(F.col("n_times"), F.col("recent"), F.col("prior"))).first()[0]
    assert got == want


@pytest.mark.parametrize(("tier", "callers", "want"), [("low", 0, "low"), ("low", 2, "medium"), ("low", 4, "high"), ("low", 8, "critical"), ("critical", 0, "critical"), ("high", 1, "high"), (None, 3, "medium")])
def test_risk_fusion(spark, tier, callers, want):
    assert one(spark, S.effective_risk(F.lit(tier).cast("string"), F.lit(callers))) == want


@pytest.mark.parametrize(("resolved", "since", "n", "want"), [(1, 0, 3, True), (1, 2, 3, False), (0, 0, 4, False), (1, 1, 3, False), (1, 1, 6, True), (1, 2, 6, False)])
def test_suppression(spark, resolved, since, n, want):
    assert one(spark, S.suppression(F.lit(resolved), F.lit(since), F.lit("stable"), F.lit(n))["suppress"]) is want


@pytest.mark.parametrize(("kind", "modules", "new", "blast", "want"), [("feature_gap", 1, True, 0, "XL"), ("feature_gap", 2, True, 0, "XL"), ("bug_fix", 1, False, 0, "S"), ("bug_fix", 1, False, 10, "L"), ("enhancement", 2, False, 0, "M"), ("bug_fix", 6, False, 0, "L")])
def test_effort(spark, kind, modules, new, blast, want):
    assert one(spark, S.effort(F.lit(kind), F.lit(modules), F.lit(new), F.lit(blast))["size"]) == want


def test_impact(spark):
    score = lambda *a: one(spark, S.impact(*map(F.lit, a)))
    gap = score("feature_gap", 12, 1, "low", "grounded", "rising")
    assert gap > 60 and one(spark, S.band(F.lit(gap))) == "high"
    assert score("bug_fix", 1, 1, "low", "grounded", "declining") < 10 and score("bug_fix", 20, 4, "critical", "grounded", "rising") > 95
    assert [one(spark, S.band(F.lit(x))) for x in (75.0, 74.99, 50.0, 25.0, 24.9)] == ["critical", "high", "high", "medium", "low"]
    assert score("bug_fix", -1, 4, "critical", "grounded", "rising") == 0


MODULES = ("app/checkout", "app/auth", "components/cart", "lib")


@pytest.mark.parametrize(("placement", "module", "body", "connections", "want", "invented"), [
    ("existing_module", "app/checkout", "", ["app/auth/", "app/auth"], "grounded", []),
    ("existing_module", "app/checkout", "", ["app/auth", "app/unknown"], "partial", ["app/unknown"]),
    ("existing_module", "app/ghost", "", [], "ungrounded", []),
    ("new_module", "app/ghost", "", ["app/ghost", "lib"], "grounded", []),
    ("existing_module", "lib", "see `app/nowhere` and app/auth", None, "partial", ["app/nowhere"]),
])
def test_gap_verdict(spark, placement, module, body, connections, want, invented):
    given = F.lit(None).cast("array<string>") if connections is None else F.array(*map(F.lit, connections)).cast("array<string>")
    r = one(spark, S.gap_verdict(F.lit(placement), F.lit(module), F.lit(""), F.lit(body), given, F.array(*map(F.lit, MODULES))))
    assert r.verdict == want and r.invented == invented


def test_freshness(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    cases = [(None, None, False), ("2026-01-01", None, True), ("2026-01-02", "2026-01-01", True), ("2026-01-01", "2026-01-02", False)]
    for a, b, want in cases:
        assert one(spark, S.proposals_stale(t(a), t(b))) is want
