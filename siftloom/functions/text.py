"""Column functions on review texts; built-in expressions only, but for NFC."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the rules count it: ASCII, Unicode spaces and the byte order mark. Fixed value.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Word starts and ends of ASCII words. Java's own boundaries differ.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def rounded(x: Column, places: int = 2) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x * 10**places + F.lit(0.5)) / F.lit(float(10**places))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def nfc(c: Column) -> Column:
    """NFC; Python only gets the texts that are not plain ASCII, the others are sent as nulls."""

    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(F.pandas_udf(compose, "string")(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalize(c: Column, composed: bool = True) -> Column:
    """NFC, no zero-width or control characters, single blanks, at most one empty line in a row, trimmed."""
    c = nfc(c) if composed else c
    for pattern, to in (
        (r"[\u200B-\u200D\uFEFF]", ""),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""),
        (r"\r\n?", "\n"),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return trimmed(c)


#: Scripts that decide a language by themselves, in this order. Fixed values.
LANGUAGE_SCRIPTS = {"ja": "[\u3041-\u30FF]", "zh": "[\u4E00-\u9FFF]", "ru": "[\u0400-\u04FF]", "th": "[\u0E00-\u0E7F]", "ar": "[\u0600-\u06FF]"}

#: Frequent words by language, for texts that neither script nor length decides. Fixed values.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it was with as be this by are at or an",
    "de": "der die das und den von zu mit sich des auf ist im dem nicht ein eine",
    "fr": "le la les des du et un une est que pour dans qui sur au par en",
    "es": "el los las y del por con una su para es al lo como se que",
    "pt": "o os as do da dos das em um uma não para com que e é ao por mais",
    "it": "il lo gli di del della che è per un una non con sono si da nel e",
    "vi": "và của là có không được cho một những trong này với các người đã",
    "id": "yang dan di dengan untuk tidak ini itu dari dalam akan pada juga",
}


def detect_language(c: Column) -> Column:
    """struct(language, confidence).

    A Hangul syllable: ko, 0.95. Under ten characters: en, 0.6 if all ASCII, else unknown, 0.
    Otherwise, at 0.8, the language of a script that one language has, if a third of the text's
    letters are of it, else the one with most frequent words among the text's words, or unknown.
    """
    share = lambda script: F.regexp_count(c, F.lit(script)) * 3 >= F.greatest(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(1))
    script = reduce(lambda rest, k: F.when(share(LANGUAGE_SCRIPTS[k]), k).otherwise(rest), reversed(list(LANGUAGE_SCRIPTS)), F.lit(None).cast("string"))
    script = F.when(c.rlike(r"[\u0400-\u06FF\u0E00-\u0E7F\u3041-\u30FF\u4E00-\u9FFF]"), script)
    words = F.split(F.lower(c), r"[^\p{L}]+")
    hits = {k: F.size(F.filter(words, _one_of(v.split()))) for k, v in LANGUAGE_WORDS.items()}
    most = F.greatest(*hits.values())
    best = reduce(lambda rest, k: F.when(hits[k] == most, k).otherwise(rest), reversed(list(LANGUAGE_WORDS)), F.lit("unknown"))
    struct = lambda lang, conf: F.struct(lang.alias("language"), F.lit(conf).alias("confidence"))
    return (
        F.when(c.rlike(r"[가-힣]"), struct(F.lit("ko"), 0.95))
        .when((F.length(c) < 10) & c.rlike(r"^[\x00-\x7F]*$"), struct(F.lit("en"), 0.6))
        .when(F.length(c) < 10, struct(F.lit("unknown"), 0.0))
        .when(script.isNotNull(), struct(script, 0.8))
        .when(most == 0, struct(F.lit("unknown"), 0.0))
        .otherwise(struct(best, 0.8))
    )


def _one_of(words: list[str]):
    return lambda w: w.isin(words)


#: (type, pattern), applied in this order; each works on what the former left. Fixed values.
PII = (
    ("URL", r"(?i)https?://[^\s<]+"),
    ("EMAIL", r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
    ("RRN", START + rf"\d{{6}}(?:-|{SPACE})?[1-4]\d{{6}}" + END),
    ("CARD", START + r"(?:\d[ -]?){15,16}(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"),
    ("PHONE", rf"(?:\+?\d{{1,3}}(?:-|{SPACE})?)?(?:\(?0\d{{1,2}}\)?(?:-|{SPACE})?)?\d{{3,4}}(?:-|{SPACE})?\d{{4}}" + END),
    ("ORDER", rf"(?i)(?:{START}(?:ORD|ORDER)|(?<=[A-Za-z0-9_])주문번호(?::|{SPACE})*)[-#]?\d{{6,}}" + END),
    ("PERSON", r"[가-힣]{2,4}(?=님)"),
    ("PERSON", rf"[가-힣]{{2,4}}(?=씨(?:{SPACE}|[,.]|$))"),
    ("PERSON", START + rf"(?:my name is|name is){SPACE}+[A-Z][a-z]+(?:{SPACE}[A-Z][a-z]+)?"),
)
PII_TYPES = ("URL", "EMAIL", "RRN", "CARD", "PHONE", "ORDER", "PERSON")


def _card(m: Column) -> Column:
    digits = F.regexp_replace(m, r"[^0-9]", "")
    return F.length(digits).between(15, 16) & F.call_function("luhn_check", digits)


def with_pii(df, text: str, redacted: str = "text_redacted", counts: str = "pii"):
    """``df`` plus the redacted text and a struct of counts; one projection per rule keeps expressions small."""
    df = df.withColumn(redacted, F.col(text))
    names = []
    for k, (kind, pattern) in enumerate(PII):
        name = f"__pii{k}"
        names.append((kind, name))
        c = F.col(redacted)
        if kind == "CARD":
            df = df.withColumn("__found", F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
            df = df.withColumn(name, F.size(F.filter("__found", _card)))
            parts = F.zip_with(F.split(c, pattern), F.col("__found"), lambda p, m: F.concat(p, F.when(m.isNull(), "").when(_card(m), "<CARD>").otherwise(m)))
            df = df.withColumn(redacted, F.when(F.size("__found") > 0, F.array_join(parts, "")).otherwise(c)).drop("__found")
        else:
            df = df.withColumn(name, F.regexp_count(c, F.lit(pattern))).withColumn(redacted, F.regexp_replace(c, pattern, f"<{kind}>"))
    total = {t: reduce(lambda a, b: a + b, [F.col(n) for kind, n in names if kind == t]) for t in PII_TYPES}
    return df.withColumn(counts, F.struct(*[total[t].cast("long").alias(t) for t in PII_TYPES])).drop(*[n for _, n in names])


def gibberish(c: Column) -> Column:
    """Spam signs of a text, 0 to 1: repeated characters, many links, few letters."""
    t = trimmed(c)
    signs = (
        F.when(t.rlike(r"(.)\1{5,}"), 0.5).otherwise(0.0)
        + F.when(F.regexp_count(t, F.lit("https?://")) >= 3, 0.5).otherwise(0.0)
        + F.when(F.length(F.regexp_replace(t, r"[\p{L}\p{N}]|" + SPACE, "")) / F.length(t) > 0.5, 0.4).otherwise(0.0)
    )
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 1.0).when(F.length(t) < 3, 0.9).otherwise(F.least(F.lit(1.0), signs))


def with_prefilter(df, text: str, out: str = "pre"):
    """``df`` plus struct(keep, reason, score): drops empty, over-long and spam texts before costly steps.

    Each sign is a column of its own, so it is worked out once a text.
    """
    df = df.withColumn("__t", trimmed(F.coalesce(F.col(text), F.lit("")))).withColumn("__n", F.length("__t"))
    df = df.withColumn("__t", F.when(F.col("__n").between(1, 8000), F.col("__t")))  # no sign counts beyond these lengths
    t = F.col("__t")
    df = df.withColumn("__solid", F.regexp_replace(t, SPACE, "")).withColumn("__m", F.length("__solid"))
    df = df.withColumn("__ratio", F.when(F.col("__m") >= 8, F.size(F.array_distinct(F.split("__solid", ""))) / F.col("__m")).otherwise(1.0))
    df = df.withColumn("__links", F.regexp_count(t, F.lit("(?i)https?://"))).withColumn("__odd", F.length(F.regexp_replace("__solid", r"[\p{L}\p{N}]", "")) / F.col("__n") > 0.5)
    flood = F.when(F.col("__ratio") < 0.2, 0.85).when(t.rlike(r"(.)\1{7,}"), 0.5).otherwise(0.0)
    bomb = F.when(F.col("__links") >= 3, 0.85).when(F.col("__links") == 2, 0.4).otherwise(0.0)
    df = df.withColumn("__score", F.least(F.lit(1.0), flood + bomb + F.when(F.col("__odd"), 0.5).otherwise(0.0)))
    df = df.withColumn("__spam", (F.col("__score") >= 0.4) & (F.col("__score") < 0.8) & (gibberish(t) > 0.7))
    score = F.col("__score")
    row = lambda keep, reason, s: F.struct(F.lit(keep).alias("keep"), F.lit(reason).cast("string").alias("reason"), s.alias("score"))
    verdict = (
        F.when(F.col("__n") < 1, row(False, "empty", F.lit(1.0)))
        .when(F.col("__n") > 8000, row(False, "too_long", F.lit(0.7)))
        .when(score >= 0.8, row(False, "heuristic_spam", score))
        .when(F.col("__spam"), row(False, "llm_escalation_spam", F.lit(0.8)))
        .otherwise(row(True, None, score))
    )
    return df.withColumn(out, verdict).drop("__t", "__n", "__solid", "__m", "__ratio", "__links", "__odd", "__score", "__spam")


#: Words that always go to a person. Fixed values.
LEGAL_WORDS = ("환불", "refund", "lawsuit", "legal", "소송", "변호사", "고소", "chargeback")
LOW_CONFIDENCE, ACCEPTED = 0.6, 0.85


def escalation_reasons(severity: Column, confidence: Column, text: Column) -> Column:
    """Why a person should look, in fixed order."""
    low = F.lower(text)
    legal = reduce(lambda a, b: a | b, [low.contains(w) for w in LEGAL_WORDS])
    return F.array_compact(F.array(F.when(severity == "critical", "critical"), F.when(legal, "refund_legal"), F.when(confidence < LOW_CONFIDENCE, "low_confidence")))


def is_low_confidence(confidence: Column) -> Column:
    return (confidence >= LOW_CONFIDENCE) & (confidence < ACCEPTED)


#: Families of error signatures, the first that fits counts. Fixed values.
ERROR_FAMILIES = (
    ("null_deref", rf"null{SPACE}*pointer|nullpointerexception|{START}npe{END}|{START}nil{END}"),
    ("http_5xx", rf"{START}5\d{{2}}{END}|5xx|server error|internal error"),
    ("http_4xx", rf"{START}4\d{{2}}{END}|4xx|not found|unauthorized|forbidden"),
    ("crash", rf"강제{SPACE}*종료|튕|크래시|crash|force{SPACE}*close|죽(?:어|음)|뻗"),
    ("hang", rf"멈춤|멈춰|먹통|응답{SPACE}*없|freeze|frozen|hang|stuck|무한{SPACE}*로딩|로딩만"),
    ("timeout", rf"타임아웃|timeout|시간{SPACE}*초과"),
    ("auth_error", rf"로그인.*안|login.*fail|인증{SPACE}*실패|auth.*error"),
)


def error_family(raw: Column) -> Column:
    return F.coalesce(*[F.when(raw.rlike("(?i)" + p), name) for name, p in ERROR_FAMILIES])


def canonical_error(raw: Column) -> Column:
    """The family, or what is left of the text without numbers; null for null or nothing."""
    rest = trimmed(F.regexp_replace(F.regexp_replace(F.lower(raw), r"\d+(\.\d+)*", ""), f"{SPACE}+", " "))
    return F.when(F.length(raw) > 0, F.coalesce(error_family(raw), F.nullif(rest, F.lit(""))))


#: Words in a path or name by risk tier. Fixed values.
RISK_WORDS = (
    ("critical", 90, "auth|security|session|token|jwt|oauth|saml|permission|acl|rbac|crypto|secret|credential|password|login|signup|register|verify|middleware|gateway|proxy|payment|billing|checkout|charge|subscription|stripe|paypal|webhook|callback"),
    ("high", 70, "api|route|router|controller|handler|endpoint|resolver|service|model|schema|database|db|repository|store|state|queue|worker|job|cron|consumer|producer|cache|redis|mongo|prisma|sequelize|typeorm|knex|sql|graphql|trpc|grpc|socket|websocket|sse|stream|upload|download|file|storage|s3|email|notification|sms"),
    ("medium", 40, "util|utils|helper|helpers|lib|common|shared|core|config|env|logger|error|exception|validator|sanitize|transform|format|parse|convert|serialize"),
)
RISK_RANKS = ("low", "medium", "high", "critical")


def code_risk(*parts: Column) -> Column:
    """struct(tier, score) of a path, module and symbol."""
    hay = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    out = F.struct(F.lit("low").alias("tier"), F.lit(10).alias("score"))
    for tier, score, words in reversed(RISK_WORDS):
        out = F.when(hay.rlike(f"(?i){START}(?:{words}){END}"), F.struct(F.lit(tier).alias("tier"), F.lit(score).alias("score"))).otherwise(out)
    return out


def risk_rank(tier: Column) -> Column:
    return F.when(tier == "critical", 3).when(tier == "high", 2).when(tier == "medium", 1).otherwise(0)


#: What users see in a component's source: headings, labels, ids of fields, tabs. Fixed values.
UI_PATTERNS = (
    r"<h[1-4][^>]*>\s*([^<>{}\n]{2,40})",
    r"<Label[^>]*>\s*([^<>{}\n]{2,40})",
    r"htmlFor=\"([a-zA-Z0-9_-]{3,40})\"",
    r"TabsTrigger[^>]*value=\"([a-zA-Z0-9_-]{2,30})\"",
)


def ui_surface(text: Column) -> Column:
    """Visible words of a component's source, each once, at most 40 of them."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in UI_PATTERNS])
    found = F.filter(F.transform(found, lambda x: trimmed(x)), lambda x: F.length(x).between(2, 40))
    return F.substring(F.array_join(F.slice(F.array_distinct(found), 1, 40), " | "), 1, 800)


def module_of(directory: Column) -> Column:
    """The first two parts of a path below a leading src; ``core`` if none."""
    parts = F.filter(F.split(F.regexp_replace(directory, r"^src(/|$)", ""), "/"), lambda x: (x != "") & (x != "."))
    name = F.array_join(F.slice(parts, 1, 2), "/")
    return F.when(F.length(name) > 0, name).otherwise("core")


def card(*parts: Column) -> Column:
    return F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts])


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def emergent_label(area: Column, mention: Column, text: Column) -> Column:
    first = F.coalesce(*[F.nullif(x, F.lit("")) for x in (area, mention, text)])
    return F.substring(trimmed(first), 1, 80)


def slug(label: Column, prefix: Column) -> Column:
    return F.substring(F.concat(F.lit("gap:"), prefix, F.lit(":"), F.regexp_replace(F.lower(label), f"{SPACE}+", "_")), 1, 200)


def set_json(document: Column, key: str, value: Column) -> Column:
    """The JSON object ``document`` with ``value`` at ``key``; other keys stay, no or a bad document counts as empty."""
    old = F.coalesce(F.try_parse_json(document), F.parse_json(F.lit("{}")))
    fields = F.coalesce(F.from_json(F.to_json(old), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(fields, lambda k, v: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(F.to_json(value)))))
