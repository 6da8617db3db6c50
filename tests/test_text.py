import pytest
from pyspark.sql import functions as F

from siftloom.functions import classify as C
from siftloom.functions import text as T


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column.alias("r")).collect()]


def test_normalize(spark):
    rows = ["  a\t\tb   c  ", "a​b", "a\r\nb\r\r\r\rc", "é", "x\x00\x9fy", None, " z﻿"]
    assert values(spark, rows, T.normalize(F.col("x"))) == ["a b c", "ab", "a\nb\n\nc", "é", "xy", None, "z"]


def test_language(spark):
    rows = ["결제가 안 돼요", "the app keeps crashing on launch", "short", "zzzzzzzzzzzzz", "ü"]
    assert values(spark, rows, T.detect_language(F.col("x"))["language"]) == ["ko", "en", "en", "unknown", "unknown"]


def test_personal_data(spark):
    rows = [
        "홍길동님 hong@x.com 010-1234-5678. 먹통이에요", "카드 4111 1111 1111 1111", "card 4111 1111 1111 1112 and 4111111111111111", "see https://a.b/c?d=1 now", "My name is x. my name is John Smith", "ORD-123456 900101-1234567", None, "",
    ]
    df = T.with_pii(spark.createDataFrame([(x,) for x in rows], "x string"), "x")
    got = [(r.text_redacted, r.pii) for r in df.collect()]
    assert got[0][0] == "<PERSON>님 <EMAIL> <PHONE>. 먹통이에요"
    assert got[1][0] == "카드 <CARD>" and got[2][1].CARD == 1 and "<CARD>" in got[2][0]
    assert got[3][0] == "see <URL> now" and got[4][0] == "My name is x. <PERSON>"
    assert got[5][0] == "<ORDER> <RRN>" and got[6] == (None, got[6][1]) and got[7][0] == ""


def test_prefilter(spark):
    rows = ["ㅋ" * 30, "a http://x http://y http://z", "로그인이 안 돼요", "", None, "a" * 24, "x" * 8001, "ab" * 30]
    got = T.with_prefilter(spark.createDataFrame([(x,) for x in rows], "x string"), "x").collect()
    assert [r.pre.reason for r in got] == ["heuristic_spam", "heuristic_spam", None, "empty", "empty", "heuristic_spam", "too_long", "heuristic_spam"]


def test_classify(spark):
    df = spark.createDataFrame([("결제할 때 앱이 튕기고 환불 안 됨", 1.0), ("최고의 앱이에요 완벽합니다", 5.0), ("", None), (None, None), ("how do i add a photo?", 3.0)], "x string, rating double")
    got = [r.c for r in C.with_category(df, "x", "rating", out="c").collect()]
    assert [r.category for r in got] == ["bug", "praise", "other", "other", "question"]
    assert got[0].severity == "critical" and got[1].sentiment == "positive" and got[2].category_confidence == 0.65 and got[2].escalated
    assert values(spark, ["결제할 때 앱이 튕기고", "upload photo", "x"], C.affected_area(F.col("x"))) == ["결제 화면", "사진 업로드", None]


def test_risk(spark):
    df = spark.createDataFrame([("Sources/Payment/PaymentView.swift", "Payment"), ("Sources/Auth/LoginViewModel.swift", None), ("PhotoUploader.upload()", ""), ("Sources/Map/MapView.swift", "Map")], "p string, m string")
    assert [r[0] for r in df.select(T.code_risk(F.col("p"), F.col("m"))["tier"]).collect()] == ["critical", "critical", "high", "low"]


def test_errors(spark):
    rows = ["강제종료됩니다", "force closes", "NullPointerException", "멈춤 현상", None, "", "Odd thing 12.5 here"]
    assert values(spark, rows, T.error_family(F.col("x"))) == ["crash", "crash", "null_deref", "hang", None, None, None]
    assert values(spark, rows, T.canonical_error(F.col("x")))[-3:] == [None, None, "odd thing here"]
    assert values(spark, ["app crash at start", "503 error now", "fine"], C.error_signature(F.col("x"))) == ["crash", "503 error", None]
    assert values(spark, ["since v2.4.1 it", "버전 3.2", "no"], C.version_hint(F.col("x"))) == ["2.4.1", "3.2", None]


def test_escalation(spark):
    df = spark.createDataFrame([("low", 0.59, "x"), ("critical", 0.6, "I want a REFUND"), ("high", 0.85, "ok")], "s string, c double, t string")
    got = df.select(T.escalation_reasons(F.col("s"), F.col("c"), F.col("t")), T.is_low_confidence(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(["low_confidence"], False), (["critical", "refund_legal"], True), ([], False)]


def test_paths_and_cards(spark):
    assert values(spark, ["src/lib", "src", "", "app/a/b", "./x"], T.module_of(F.col("x"))) == ["lib", "core", "core", "app/a", "x"]
    assert values(spark, ['<h1 class="x"> Title</h1><Label>Name</Label><i htmlFor="rsi-x"/><TabsTrigger value="tab"/>'], T.ui_surface(F.col("x"))) == ["Title | Name | rsi-x | tab"]
    assert values(spark, ["a"], T.card(F.col("x"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))) == ["a · b"]


@pytest.mark.parametrize(("x", "want"), [(-0.125, -0.12), (0.125, 0.13), (1.005, 1.0)])
def test_rounding(spark, x, want):
    assert values(spark, [x], T.rounded(F.col("x")), "x double") == [want]


def test_mapping(spark):
    df = spark.createDataFrame([("차트가 안 떠요", "bug"), ("please add charts", "feature_request"), ("nice graph", "praise")], "t string, c string")
    score = C.overlap(C.expand_hints(F.col("t")), F.lit("stockgraph shows a chart"))
    got = df.select(C.mapping_state(score, F.col("t"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["defective", "gap", "grounded"]
