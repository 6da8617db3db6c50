"""Scores and verdicts as columns: trend, impact, effort, suppression, gap checks, drift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import RISK_RANKS, risk_rank, rounded

WINDOW_DAYS = 14

#: Weights and bands of the impact score. Fixed values.
SEVERITY_VALUE = {1: 0.25, 2: 0.5, 3: 0.75, 4: 1.0}
RISK_VALUE = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
VERDICT_CONFIDENCE = {"grounded": 1.0, "partial": 0.7, "ungrounded": 0.4}
MOMENTUM = {"rising": 1.0, "new": 0.85, "stable": 0.85, "declining": 0.6}
BANDS = (("critical", 75), ("high", 50), ("medium", 25))
GAP_VALUE, ENHANCEMENT_VALUE, EVIDENCE_HALF = 0.7, 0.45, 4
EFFORT_WEEKS = {"S": "~3 days", "M": "1–2 wks", "L": "2–4 wks", "XL": "4+ wks"}


def pick(values: dict, key: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def window_counts(ts: Column, now: Column, days: int = WINDOW_DAYS) -> tuple[Column, Column, Column]:
    """Aggregates (valid, recent, prior) of report times: ages up to one window, and up to two."""
    age = now.cast("double") - ts.cast("double")
    w = days * 86400.0
    return F.count(ts).alias("n_times"), F.count_if(age <= w).alias("recent"), F.count_if((age > w) & (age <= 2 * w)).alias("prior")


def trend(n: Column, recent: Column, prior: Column) -> Column:
    return (
        F.when(n <= 1, "new").when(recent == 0, "declining").when(prior == 0, "rising")
        .when(recent > prior, "rising").when(recent < prior, "declining").otherwise("stable")
    )


def blast_tier(callers: Column) -> Column:
    return F.when(callers >= 8, "critical").when(callers >= 4, "high").when(callers >= 2, "medium").otherwise("low")


def effective_risk(tier: Column, callers: Column) -> Column:
    """The stronger of the path's tier and the number of callers."""
    rank = F.greatest(risk_rank(tier), risk_rank(blast_tier(callers)))
    return F.element_at(F.array(*map(F.lit, RISK_RANKS)), rank + 1)


def impact(kind: Column, count: Column, severity: Column, risk: Column, verdict: Column, trend_: Column) -> Column:
    """Score 0 to 100 on one scale for bug_fix, feature_gap and enhancement."""
    n = F.when(count > 0, count).otherwise(0)
    evidence = 1 - F.exp(-n / F.lit(float(EVIDENCE_HALF)))
    value = F.when(kind == "bug_fix", 0.6 * pick(SEVERITY_VALUE, severity) + 0.4 * pick(RISK_VALUE, risk)).when(kind == "feature_gap", GAP_VALUE).otherwise(ENHANCEMENT_VALUE)
    sure = F.when(kind == "feature_gap", pick(VERDICT_CONFIDENCE, verdict)).otherwise(1.0)
    return rounded(100 * evidence * value * sure * pick(MOMENTUM, trend_))


def band(score: Column) -> Column:
    out = F.lit("low")
    for name, least in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def suppression(resolved: Column, since: Column, trend_: Column, corroboration: Column) -> Column:
    """struct(suppress, reason): a proposal rests while its reports stay resolved."""
    tolerance = F.when(corroboration >= 5, 1).otherwise(0)
    text = lambda x: x.cast("string")
    back = F.concat(F.lit("regression: "), text(since), F.lit(" new defect report(s) after resolution (tolerance "), text(tolerance), F.lit(") — resurface"))
    late = F.when(since > 0, F.concat(F.lit(" ("), text(since), F.lit(" late report within tolerance "), text(tolerance), F.lit(")"))).otherwise("")
    fades = F.when(trend_ == "declining", " (trend declining — confirms fade)").otherwise("")
    rests = F.concat(F.lit("resolved by "), text(resolved), F.lit(" report(s), no regression"), late, fades)
    row = lambda s, r: F.struct(F.lit(s).alias("suppress"), r.alias("reason"))
    return F.when(resolved <= 0, row(False, F.lit("no resolution report — proposal stands"))).when(since > tolerance, row(False, back)).otherwise(row(True, rests))


def effort(kind: Column, modules: Column, is_new: Column, blast: Column) -> Column:
    """struct(size, weeks, rationale)."""
    sizes = F.array(*map(F.lit, EFFORT_WEEKS))
    gap = kind == "feature_gap"
    base = F.when(gap, 1).otherwise(0)
    new = F.when(gap & is_new, 2).otherwise(0)
    spans = F.when(modules >= 5, 2).when(modules >= 2, 1).otherwise(0)
    cares = F.when(blast >= 8, 2).when(blast >= 3, 1).otherwise(0)
    size = F.element_at(sizes, F.least(F.lit(3), base + new + spans + cares) + 1)
    why = F.concat_ws(
        ", ",
        F.concat(kind, F.lit(" base "), F.element_at(sizes, base + 1)),
        F.when(new > 0, "new module (+2)"),
        F.when(spans > 0, F.concat(F.lit("spans "), modules.cast("string"), F.lit(" modules (+"), spans.cast("string"), F.lit(")"))),
        F.when(cares > 0, F.concat(F.lit("blast-radius "), blast.cast("string"), F.lit(" (+"), cares.cast("string"), F.lit(")"))),
    )
    weeks = F.lit(None).cast("string")
    for k, v in EFFORT_WEEKS.items():
        weeks = F.when(size == k, v).otherwise(weeks)
    return F.struct(size.alias("size"), weeks.alias("weeks"), why.alias("rationale"))


#: Module names in texts. Fixed values.
MODULE_PATH = r"(?<![A-Za-z0-9_])(app/[a-z0-9-]+|components/[a-z0-9-]+|app|components|lib|hooks)(?![A-Za-z0-9_])"
QUOTED_NAME = "`([a-zA-Z0-9/_-]{2,40})`"


def named_modules(module: Column, connection: Column, body: Column, connections: Column) -> Column:
    """All names in a placement that may be modules: what ``gap_verdict`` has to know of the real ones."""
    norm = lambda x: F.trim(F.regexp_replace(x, r"[`/]+$", ""))
    text = F.concat_ws("\n", module, connection, body)
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (MODULE_PATH, QUOTED_NAME)]
    return F.array_distinct(F.concat(F.array(module), F.transform(F.concat(F.coalesce(connections, F.array().cast("array<string>")), *found), norm)))


def gap_verdict(placement: Column, module: Column, connection: Column, body: Column, connections: Column, modules: Column) -> Column:
    """struct(verdict, referenced, invented, module_exists) of a placement against the real ``modules``.

    Structured connections are trusted; without any, module names are read from the texts.
    """
    norm = lambda x: F.trim(F.regexp_replace(x, r"[`/]+$", ""))
    given = F.transform(connections, norm)
    text = F.concat_ws("\n", module, connection, body)
    paths = F.transform(F.regexp_extract_all(text, F.lit(MODULE_PATH), F.lit(1)), norm)
    quoted = F.transform(F.regexp_extract_all(text, F.lit(QUOTED_NAME), F.lit(1)), norm)
    quoted = F.filter(quoted, lambda t: (t != "") & (t.contains("/") | F.array_contains(modules, t)))
    read = F.array_distinct(F.concat(paths, quoted))
    structured = F.coalesce(F.size(connections) > 0, F.lit(False))
    real = F.array_intersect(F.when(structured, given).otherwise(read), modules)
    alien = F.array_except(F.when(structured, given).otherwise(F.filter(read, lambda t: t.rlike("^(app|components|lib|hooks)/"))), F.array_union(modules, F.array(module)))
    exists = (placement == "new_module") | F.array_contains(modules, module)
    verdict = F.when(~exists, "ungrounded").when(F.size(alien) > 0, "partial").otherwise("grounded")
    return F.struct(verdict.alias("verdict"), real.alias("referenced"), alien.alias("invented"), exists.alias("module_exists"))


def proposals_stale(last_processed: Column, last_proposal: Column) -> Column:
    return F.when(last_processed.isNull(), False).when(last_proposal.isNull(), True).otherwise(last_processed > last_proposal)
