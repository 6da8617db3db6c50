"""Queries of the per-review text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..sources.tables import load

#: A rating for every document, so that the classifier's rating rules are used.
RATING = "nullif(doc_id % 6, 0)"
_RUN = lambda n: f"len(list_filter(range(1, len(ch) - {n - 2}), lambda i: ch[i] <> chr(10) AND " + " AND ".join(f"ch[i] = ch[i + {k}]" for k in range(1, n)) + ")) > 0"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def normalize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts by source: rows, characters, texts that change, distinct contents."""
    docs = load(spark, sf_dir, "documents").select("source", "text").withColumn("n", T.normalize(F.col("text")))
    return docs.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.sum(F.length("n")).alias("n_chars"), F.count_if(~F.col("n").eqNullSafe(F.col("text"))).alias("n_changed"), F.countDistinct(T.content_hash(F.col("n"))).alias("n_contents"),
    )


_NORMALIZED = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"

NORMALIZE_SQL = f"""
WITH n AS (SELECT source, text, {_NORMALIZED} AS n FROM documents)
SELECT source, count(*) AS n_rows, sum(length(n))::bigint AS n_chars, count(*) FILTER (WHERE n IS DISTINCT FROM text) AS n_changed, count(DISTINCT substr(sha256(n), 1, 16)) AS n_contents
FROM n GROUP BY source
"""


def pii_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements and texts with one, by type of personal data."""
    docs = T.with_pii(load(spark, sf_dir, "documents").select("text"), "text")
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("pii_type"), F.coalesce(F.col(f"pii.{t}"), F.lit(0)).alias("n")) for t in T.PII_TYPES]))
    return docs.select(pairs.alias("p")).groupBy("p.pii_type").agg(F.sum("p.n").alias("n_found"), F.count_if(F.col("p.n") > 0).alias("n_texts"))


_LUHN = "len(x) BETWEEN 15 AND 16 AND list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (len(x) - i) % 2 = 0 THEN x[i]::int WHEN x[i]::int * 2 > 9 THEN x[i]::int * 2 - 9 ELSE x[i]::int * 2 END)) % 10 = 0"


def _pii_sql() -> str:
    steps = [("URL", r"(?i)https?://[^\s<]+"), ("EMAIL", r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), ("RRN", r"\b\d{6}[-\s]?[1-4]\d{6}\b")]
    after = [
        ("PHONE", r"(?:\+?\d{1,3}[-\s]?)?(?:\(?0\d{1,2}\)?[-\s]?)?\d{3,4}[-\s]?\d{4}\b"), ("ORDER", r"(?i)\b(?:ORD|ORDER|주문번호[:\s]*)[-#]?\d{6,}\b"),
        ("PERSON", r"\b(?:my name is|name is)\s+[A-Z][a-z]+(?:\s[A-Z][a-z]+)?"),
    ]
    sql, last = "WITH s0 AS (SELECT coalesce(text, '') AS t FROM documents)", "s0"
    kept = []
    for k, (kind, p) in enumerate(steps, 1):
        sql += f", s{k} AS (SELECT {''.join(f'{c}, ' for c in kept)}len(regexp_extract_all(t, '{p}')) AS n_{kind}, regexp_replace(t, '{p}', '<{kind}>', 'g') AS t FROM {last})"
        kept, last = [*kept, f"n_{kind}"], f"s{k}"
    card = r"\b(?:\d[ -]?){15,16}\b"
    sql += f", c1 AS (SELECT *, regexp_extract_all(t, '{card}') AS found FROM {last})"
    sql += f", c2 AS (SELECT *, list_transform(list_transform(found, lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda x: {_LUHN}) AS good, string_split_regex(t, '{card}') AS part FROM c1)"
    sql += f", c3 AS (SELECT {', '.join(kept)}, len(list_filter(good, lambda x: x)) AS n_CARD, array_to_string(list_transform(range(1, len(part) + 1), lambda i: part[i] || CASE WHEN i > len(found) THEN '' WHEN good[i] THEN '<CARD>' ELSE found[i] END), '') AS t FROM c2)"
    kept, last = [*kept, "n_CARD"], "c3"
    for k, (kind, p) in enumerate(after, 4):
        sql += f", s{k} AS (SELECT {', '.join(kept)}, len(regexp_extract_all(t, '{p}')) AS n_{kind}, regexp_replace(t, '{p}', '<{kind}>', 'g') AS t FROM {last})"
        kept, last = [*kept, f"n_{kind}"], f"s{k}"
    return sql + " " + " UNION ALL ".join(f"SELECT '{t}' AS pii_type, sum(n_{t})::bigint AS n_found, count(*) FILTER (WHERE n_{t} > 0) AS n_texts FROM {last}" for t in T.PII_TYPES)


def prefilter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the prefilter keeps or drops, by reason."""
    docs = T.with_prefilter(load(spark, sf_dir, "documents").select("text"), "text", "p")
    return docs.groupBy(F.coalesce("p.reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), T.rounded(F.max("p.score")).alias("max_score"))


PREFILTER_SQL = rf"""
WITH a AS (
  SELECT regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents
), b AS (
  SELECT t, CASE WHEN length(t) <= 8000 THEN string_split(t, '') ELSE [] END AS ch, CASE WHEN length(t) <= 8000 THEN string_split(regexp_replace(t, '\s', '', 'g'), '') ELSE [] END AS solid,
         len(regexp_extract_all(t, '(?i)https?://')) AS links, length(regexp_replace(t, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(length(t), 1) AS odd FROM a
), c AS (
  SELECT t, links, odd, {_RUN(8)} AS run8, {_RUN(6)} AS run6, CASE WHEN len(solid) >= 8 THEN len(list_distinct(solid)) / len(solid) ELSE 1 END AS uniq FROM b
), d AS (
  SELECT *, least(1.0, CASE WHEN uniq < 0.2 THEN 0.85 WHEN run8 THEN 0.5 ELSE 0 END + CASE WHEN links >= 3 THEN 0.85 WHEN links = 2 THEN 0.4 ELSE 0 END + CASE WHEN odd > 0.5 THEN 0.5 ELSE 0 END) AS s,
         CASE WHEN length(t) < 3 THEN 0.9 ELSE least(1, CASE WHEN run6 THEN 0.5 ELSE 0 END + CASE WHEN links >= 3 THEN 0.5 ELSE 0 END + CASE WHEN odd > 0.5 THEN 0.4 ELSE 0 END) END AS g FROM c
), e AS (
  SELECT CASE WHEN length(t) < 1 THEN 'empty' WHEN length(t) > 8000 THEN 'too_long' WHEN s >= 0.8 THEN 'heuristic_spam' WHEN s >= 0.4 AND g > 0.7 THEN 'llm_escalation_spam' ELSE 'kept' END AS reason,
         CASE WHEN length(t) < 1 THEN 1 WHEN length(t) > 8000 THEN 0.7 WHEN s < 0.8 AND s >= 0.4 AND g > 0.7 THEN 0.8 ELSE s END AS score FROM d
)
SELECT reason, count(*) AS n, floor(max(score)::double * 100 + 0.5) / 100 AS max_score FROM e GROUP BY reason
"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text", F.expr(f"cast({RATING} as double)").alias("rating"))
    return C.with_category(docs, "text", "rating", out="c")


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, confidence, sentiment and severity of every document."""
    return _classified(spark, sf_dir).select("doc_id", *[f"c.{x}" for x in ("category", "category_confidence", "escalated", "sentiment", "sentiment_score", "severity", "is_resolution_report")])


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(low, {_quoted(w)})::int" for w in words)


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, {_quoted(w)})" for w in words) + ")"


_HALF_UP = "floor(({}) * 100 + 0.5) / 100"
_CLASSIFIED = f"""
a AS (
  SELECT doc_id, source, text, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, ({RATING})::double AS rating FROM documents
), s AS (
  SELECT *, [{", ".join(f"({_hits(C.KEYWORDS[c])})::double" + {"bug": " + bad", "complaint": " + bad", "praise": " + good", "question": " + contains(t, '?')::int"}.get(c, "") for c in C.KEYWORDS)}, 0] AS sc
  FROM (SELECT *, CASE WHEN rating <= 2 THEN 0.5 ELSE 0 END AS bad, CASE WHEN rating >= 4 THEN 0.5 ELSE 0 END AS good FROM a)
), r AS (
  SELECT *, list_reverse_sort(sc)[1] AS top, list_reverse_sort(sc)[2] AS sec, {_any(C.RESOLVED)} AS res, {_any(C.CRITICAL)} AS crit FROM s
), m AS (
  SELECT *, CASE WHEN top > 0 THEN [{", ".join(_quoted(c) for c in C.CATEGORIES)}][list_position(sc, top)] ELSE 'other' END AS category,
         CASE WHEN top > 0 THEN least(0.95::double, 0.6::double + 0.35::double * ((top - sec) / top) + least(top, 3) * 0.03::double) ELSE 0.45::double END AS raw FROM r
), f AS (
  SELECT *, (category = 'praise' OR (res AND coalesce(rating, 3) >= 3)) AS pos, category IN ('bug', 'complaint') AS neg FROM m
), c AS (
  SELECT doc_id, source, text, category, {_HALF_UP.format("CASE WHEN raw < 0.6 THEN least(0.7::double, raw + 0.2::double) ELSE raw END")} AS category_confidence, raw < 0.6 AS escalated,
         CASE WHEN pos THEN 'positive' WHEN neg THEN 'negative' ELSE 'neutral' END AS sentiment,
         {_HALF_UP.format("CASE WHEN rating IS NOT NULL THEN greatest(-1::double, least(1::double, CASE WHEN pos THEN 0.7::double WHEN neg THEN -0.6::double ELSE 0 END + (rating - 3) * 0.15::double)) ELSE CASE WHEN pos THEN 0.7::double WHEN neg THEN -0.6::double ELSE 0 END END")} AS sentiment_score,
         CASE WHEN category = 'bug' AND crit THEN 'critical' WHEN category = 'bug' THEN 'high' WHEN category = 'complaint' THEN 'medium' ELSE 'low' END AS severity, res AS is_resolution_report FROM f
)"""
CLASSIFY_SQL = f"WITH {_CLASSIFIED} SELECT doc_id, category, category_confidence, escalated, sentiment, sentiment_score, severity, is_resolution_report FROM c"


def category_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by category with their share in percent, one decimal."""
    n = _classified(spark, sf_dir).groupBy(F.col("c.category").alias("category")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("category", "n", (F.floor(F.col("n") / F.col("total") * 1000 + 0.5) / 10).alias("share"))


DASHBOARD_SQL = f"WITH {_CLASSIFIED} SELECT category, count(*) AS n, floor(count(*)::double / sum(count(*)) OVER () * 1000 + 0.5) / 10 AS share FROM c GROUP BY category"


_COMPLAINTS = ("", " the app crashes and all my data is lost", " I want a refund or my lawyer will sue", " crash crash on payment, refund", " maybe", " slow slow slow")


def escalation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for which reports go to a person: documents, to every third of which words of a complaint are added."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, _COMPLAINTS)), (F.col("doc_id") % len(_COMPLAINTS) + 1).cast("int"))).alias("text"), F.expr(f"cast({RATING} as double)").alias("rating"))
    rows = C.with_category(docs, "text", "rating", out="c")
    reasons = T.escalation_reasons(F.col("c.severity"), F.col("c.category_confidence"), F.col("text"))
    return rows.select("source", F.explode(F.array_distinct(reasons)).alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))


ESCALATION_SQL = f"""
WITH {_CLASSIFIED.replace("rating FROM documents", "rating FROM (SELECT * REPLACE (coalesce(text, '') || [" + ", ".join(map(_quoted, _COMPLAINTS)) + f"][doc_id % {len(_COMPLAINTS)} + 1] AS text) FROM documents)")}, q AS (
  SELECT source, unnest([CASE WHEN severity = 'critical' THEN 'critical' END, CASE WHEN {" OR ".join(f"contains(lower(coalesce(text, '')), {_quoted(w)})" for w in T.LEGAL_WORDS)} THEN 'refund_legal' END, CASE WHEN category_confidence < 0.6 THEN 'low_confidence' END]) AS reason FROM c
)
SELECT source, reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY ALL
"""


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected against stated languages."""
    docs = load(spark, sf_dir, "documents").select("lang", T.detect_language(F.coalesce("text", F.lit(""))).alias("d"))
    return docs.groupBy("lang", F.col("d.language").alias("language"), F.col("d.confidence").alias("confidence")).agg(F.count("*").alias("n"))


def _language_sql() -> str:
    count = {k: "len(list_filter(w, lambda x: x IN (" + ", ".join(map(_quoted, v.split())) + ")))" for k, v in T.LANGUAGE_WORDS.items()}
    most = f"greatest({', '.join(f'n_{k}' for k in count)})"
    share = {k: rf"len(regexp_extract_all(t, '{p}')) * 3 >= greatest(1, len(regexp_extract_all(t, '\p{{L}}')))" for k, p in T.LANGUAGE_SCRIPTS.items()}
    script, known = " ".join(f"WHEN {s} THEN '{k}'" for k, s in share.items()), " ".join(f"WHEN {s} THEN 0.8" for s in share.values())
    return rf"""
WITH a AS (SELECT lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT lang, t, string_split_regex(lower(t), '[^\p{{L}}]+') AS w FROM a),
c AS (SELECT lang, t, {", ".join(f"{s} AS n_{k}" for k, s in count.items())} FROM b),
d AS (SELECT lang, CASE WHEN regexp_matches(t, '[가-힣]') THEN 'ko' WHEN length(t) < 10 AND regexp_full_match(t, '[\x00-\x7F]*') THEN 'en' WHEN length(t) < 10 THEN 'unknown' {script} WHEN {most} = 0 THEN 'unknown' {" ".join(f"WHEN n_{k} = {most} THEN '{k}'" for k in count)} END AS language,
  CASE WHEN regexp_matches(t, '[가-힣]') THEN 0.95 WHEN length(t) < 10 AND regexp_full_match(t, '[\x00-\x7F]*') THEN 0.6 WHEN length(t) < 10 THEN 0 {known} WHEN {most} = 0 THEN 0 ELSE 0.8 END::double AS confidence FROM c)
SELECT lang, language, confidence, count(*) AS n FROM d GROUP BY ALL
"""


def error_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error expressions made of events, by family and canonical form."""
    raw = F.concat_ws(" ", "event_type", F.floor(F.col("value") * 10).cast("string"), F.element_at(F.array(*map(F.lit, ("timeout", "npe", "Force  Close", "app hang 2.1", "not found", "other 3"))), (F.col("event_id") % 6 + 1).cast("int")))
    ev = load(spark, sf_dir, "events").select(raw.alias("raw"))
    return ev.groupBy(T.error_family(F.col("raw")).alias("family"), T.canonical_error(F.col("raw")).alias("canonical")).agg(F.count("*").alias("n"))


def _errors_sql() -> str:
    plain = {"null_deref": r"null\s*pointer|nullpointerexception|\bnpe\b|\bnil\b", "http_5xx": r"\b5\d{2}\b|5xx|server error|internal error", "http_4xx": r"\b4\d{2}\b|4xx|not found|unauthorized|forbidden", "crash": r"crash|force\s*close", "hang": "freeze|frozen|hang|stuck", "timeout": "timeout", "auth_error": "login.*fail|auth.*error"}
    family = "CASE " + " ".join(f"WHEN regexp_matches(raw, '(?i){p}') THEN '{k}'" for k, p in plain.items()) + " END"
    return rf"""
WITH r AS (SELECT event_type || ' ' || floor(value * 10)::bigint::varchar || ' ' || ['timeout', 'npe', 'Force  Close', 'app hang 2.1', 'not found', 'other 3'][event_id % 6 + 1] AS raw FROM events),
f AS (SELECT raw, {family} AS family FROM r)
SELECT family, coalesce(family, nullif(trim(regexp_replace(regexp_replace(lower(raw), '\d+(\.\d+)*', '', 'g'), '\s+', ' ', 'g')), '')) AS canonical, count(*) AS n FROM f GROUP BY ALL
"""


_PATHS = ("Sources/Payment/PaymentView.ts", "src/auth/LoginViewModel.ts", "upload/photo.ts", "src/map/MapView.ts", "lib/string_utils.ts", "a/helpers/x.ts", "paymentView.ts", "db-schema")


def code_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk tiers of paths made for parts."""
    parts = load(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % len(_PATHS) + 1).cast("int")).alias("path"), "p_brand")
    r = T.code_risk(F.col("path"), F.col("p_brand"))
    return parts.groupBy("path", r["tier"].alias("tier"), r["score"].alias("score")).agg(F.count("*").alias("n"))


RISK_SQL = f"""
WITH p AS (SELECT [{", ".join(map(_quoted, _PATHS))}][p_partkey % {len(_PATHS)} + 1] AS path, p_brand FROM part),
t AS (SELECT path, CASE {" ".join(rf"WHEN regexp_matches(path || ' ' || p_brand, '(?i)\b(?:{w})\b') THEN '{t}'" for t, _, w in T.RISK_WORDS)} ELSE 'low' END AS tier FROM p)
SELECT path, tier, CASE tier {" ".join(f"WHEN '{t}' THEN {s}" for t, s, _ in T.RISK_WORDS)} ELSE 10 END AS score, count(*) AS n FROM t GROUP BY ALL
"""


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderation figures of conversation turns by role."""
    rows = C.with_category(load(spark, sf_dir, "conversations").select("role", "text"), "text", out="c")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count_if("c.is_spam").alias("n_spam"), T.rounded(F.avg("c.quality_score"), 4).alias("avg_quality"))


QUALITY_SQL = rf"""
WITH a AS (SELECT role, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations),
b AS (SELECT *, string_split(t, '') AS ch, len(regexp_extract_all(t, 'https?://')) AS links, length(regexp_replace(t, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(length(t), 1) AS odd FROM a),
c AS (SELECT role, CASE WHEN length(x) = 0 THEN 1 WHEN length(t) < 3 THEN 0.9 ELSE least(1, CASE WHEN {_RUN(6)} THEN 0.5 ELSE 0 END + CASE WHEN links >= 3 THEN 0.5 ELSE 0 END + CASE WHEN odd > 0.5 THEN 0.4 ELSE 0 END) END AS spam,
  floor(greatest(0.1, least(1, length(x)::double / 80)) * 100 + 0.5) / 100 AS q FROM b)
SELECT role, count(*) AS n, count(*) FILTER (WHERE spam > 0.6) AS n_spam, floor(avg(q) * 10000 + 0.5) / 10000 AS avg_quality FROM c GROUP BY role
"""


def feature_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area words in page texts, and the area that each page is about."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("t"))
    return pages.select("page_id", F.array_join(C.feature_mentions(F.col("t")), ",").alias("mentions"), C.affected_area(F.col("t")).alias("area"))


MENTIONS_SQL = f"""
WITH a AS (SELECT page_id, lower(coalesce(html, '')) AS low FROM pages)
SELECT page_id, array_to_string(list_filter([{", ".join(f"CASE WHEN contains(low, {_quoted(w)}) THEN {_quoted(w)} END" for _, ws in C.AREAS for w in ws)}], lambda x: x IS NOT NULL), ',') AS mentions,
  CASE {" ".join(f"WHEN {_any(ws)} THEN {_quoted(a)}" for a, ws in C.AREAS)} END AS area FROM a
"""


def ui_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and labels of every page."""
    return load(spark, sf_dir, "pages").select("page_id", T.ui_surface(F.coalesce("html", F.lit(""))).alias("surface"))


UI_SQL = rf"""
WITH a AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
b AS (SELECT page_id, list_concat({", ".join(f"regexp_extract_all(t, '{p}', 1)" for p in T.UI_PATTERNS)}) AS f FROM a),
c AS (SELECT page_id, list_filter(list_transform(f, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 2 AND 40) AS f FROM b),
d AS (SELECT page_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS f FROM c)
SELECT page_id, coalesce(substr(array_to_string(f[1:40], ' | '), 1, 800), '') AS surface FROM d
"""


_FAILURES = ("", " NullPointerException at start, app version 2.4.1", " HTTP 503 error on save v1.20", " the app crash-es, Force  Close", " 화면이 멈춤 버전 3.1.4", " E오류 code: 42x", " 저장 버튼을 누르면 꺼져요. 사진을 선택하면 멈춰요! 목록을 길게 누르면 닫혀요. 다시 누르면", " a404b 5xx v9")


def error_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error expressions, version hints and steps in conversation turns, to which words of failures are added in turn."""
    t = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, _FAILURES)), ((F.col("conv_id") + F.col("turn")) % len(_FAILURES) + 1).cast("int")))
    steps = F.array_join(C.reproduction_steps(t), "|")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", C.error_signature(t).alias("signature"), C.version_hint(t).alias("version"), steps.alias("steps"))


_ERRORS = (r"null\s*pointer|nullpointerexception|npe|nil\b", r"\b[45]\d{2}\b\s*(?:error|에러)?", r"강제\s*종료|튕(?:겨|김|기)|크래시|crash|force\s*close", r"멈춤|멈춰|먹통|freeze|frozen|무한\s*로딩", r"\b(?:error|에러|오류)\s*(?:code\s*)?[:#]?\s*[A-Za-z0-9_]+")
SIGNATURES_SQL = rf"""
WITH a AS (SELECT conv_id, turn, coalesce(text, '') || [{", ".join(map(_quoted, _FAILURES))}][(conv_id + turn) % {len(_FAILURES)} + 1] AS t FROM conversations)
SELECT conv_id, turn, coalesce({", ".join(f"nullif(regexp_extract(t, '(?i){p}', 0), '')" for p in _ERRORS)}) AS signature, nullif(regexp_extract(t, '(?i)(?:^|[^A-Za-z0-9_])(?:v|버전\s*)?(\d+\.\d+(?:\.\d+)?)\b', 1), '') AS version,
  array_to_string(list_transform(regexp_extract_all(t, '[^.。!?\n]{{4,40}}?(?:할 때|누르면|하면|을 누르면|를 누르면)')[1:3], lambda x: trim(x)), '|') AS steps FROM a
"""


QUERIES = {f.__name__: f for f in (category_dashboard, normalize_stats, pii_by_type, prefilter_funnel, classify_documents, escalation_queue, language_counts, error_families, code_risk, quality_score, feature_mentions, ui_surface, error_signatures)}
ORACLES = {
    "category_dashboard": DASHBOARD_SQL, "normalize_stats": NORMALIZE_SQL, "pii_by_type": _pii_sql(), "prefilter_funnel": PREFILTER_SQL, "classify_documents": CLASSIFY_SQL, "escalation_queue": ESCALATION_SQL,
    "language_counts": _language_sql(), "error_families": _errors_sql(), "code_risk": RISK_SQL, "quality_score": QUALITY_SQL, "feature_mentions": MENTIONS_SQL, "ui_surface": UI_SQL, "error_signatures": SIGNATURES_SQL,
}
