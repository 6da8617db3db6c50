"""Registries, languages, batch hashes, mapping bounds, reports."""

import json
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftloom.functions import text as T
from siftloom.functions import vectors as V
from siftloom.operators import analytics as A
from siftloom.operators import insight as I
from siftloom.operators import reviews as R
from siftloom.operators import signals as G
from siftloom.sources.tables import seeded


@pytest.mark.parametrize(("text", "language"), [
    ("앱이 자꾸 꺼져요", "ko"), ("short", "en"), ("крáтко", "unknown"), ("приложение закрывается при входе", "ru"), ("アプリがすぐに落ちてしまいます", "ja"), ("应用程序每次打开都会崩溃", "zh"),
    ("แอปปิดเองทุกครั้ง", "th"), ("التطبيق يتعطل عند الفتح", "ar"), ("the app is slow and it crashes with every start", "en"), ("die app ist sehr langsam und stürzt mit jedem start ab", "de"),
    ("o aplicativo não abre e os dados da conta são perdidos", "pt"), ("l'app non si apre e i dati del conto sono persi", "it"), ("ứng dụng không được và các người đã mất dữ liệu", "vi"), ("aplikasi ini tidak bisa dibuka dan data yang lama hilang", "id"),
    ("la aplicación no abre y los datos del usuario se pierden", "es"), ("qxz vvk pqr zzt wlk", "unknown"), ("the word 日本 is in an English text that is long enough", "en"),
])
def test_languages(spark, text, language):
    assert spark.range(1).select(T.detect_language(F.lit(text))["language"]).first()[0] == language


def test_nfc_sends_only_other_texts(spark):
    rows = ["plain", "été", None, "", "ä"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(T.nfc(F.col("t"))).collect()] == ["plain", "été", None, "", "ä"]


def test_batches_hash_as_single_texts_do():
    rng = random.Random(8)
    texts = [None, "", "a", "ab", "abc", "ABC  abc", "é" * 5] + [" ".join(rng.choice(["crash", "slow", "앱이", "login", "x"]) for _ in range(rng.randrange(30))) for _ in range(600)]
    assert V._hash_all(pd.Series(texts)).tolist() == [V.simhash_of(t) for t in texts]
    got = np.array(V._embed_all(pd.Series(texts)).tolist())
    assert np.abs(got - np.array([V.embedding_of(t) for t in texts])).max() < 1e-6
    assert len(V._hash_all(pd.Series([], dtype=object))) == len(V._embed_all(pd.Series([], dtype=object))) == 0


def test_seeded_registries(spark):
    f, a = seeded(spark, [{"repo": "app", "id": "pay", "label": "Pay", "description": "card payment", "aliases": ["checkout"]}, {"repo": "app", "id": "pay", "label": "Payment", "parent_id": "shop"}], [{"repo": "app", "id": "x", "kind": "file", "path": "src/payment/card.ts", "module": "payment", "feature_ids": ["pay"]}])
    (f,), (a,) = f.collect(), a.collect()
    assert (f.label, f.state, len(f.v)) == ("Payment", "grounded", V.DIM) and (a.risk_tier, a.feature_ids) == ("critical", ["pay"]) and abs(np.linalg.norm(a.v) - 1) < 1e-5
    assert all(x.count() == 0 for x in seeded(spark, [], []))


def test_only_grounded_features_of_the_repository_are_mapped(spark):
    v = V.embedding_of("login page").tolist()
    rows = [("good", "app", "grounded", "root"), ("gap", "app", "gap", "root"), ("root", "app", "grounded", None), ("other", "web", "grounded", "root")]
    features = spark.createDataFrame([(i, r, s, p, "login", "login page", v) for i, r, s, p in rows], "id string, repo string, state string, parent_id string, label string, description string, v array<double>")
    asked = spark.createDataFrame([("s1", "bug", "login page fails", "login", [], v)], "seq string, category string, text_redacted string, area string, mentions array<string>, v array<double>").withColumn("c", F.struct("category"))
    assert [r.feature_id for r in R.map_features(asked, features, "app").collect()] == ["good"]


def test_groups_take_members_and_resolutions(spark):
    g = spark.createDataFrame([("g", [1.0, 0.0], 2, ["1"], ["web"], datetime(2026, 1, 5), 0.3, 1), ("h", [0.0, 1.0], 1, [], [], datetime(2026, 1, 1), 0.0, 0)], "group_id string, vector array<double>, corroboration long, versions array<string>, platforms array<string>, last_seen timestamp, max_radius double, resolution_count long")
    new = spark.createDataFrame([("g", datetime(2026, 1, 2), "2", None, [1.0, 1.0]), ("g", datetime(2026, 1, 3), "1", "ios", [1.0, 0.0])], "group_id string, created_at timestamp, app_version string, platform string, v array<double>")
    solved = spark.createDataFrame([("g", "r1"), ("g", "r1"), ("g", "r2")], "group_id string, review_id string")
    got = {r.group_id: r for r in G.with_resolutions(G.with_members(g, new), solved).collect()}
    assert (got["g"].corroboration, got["g"].versions, got["g"].platforms, got["g"].last_seen, got["g"].max_radius, got["g"].resolution_count) == (4, ["1", "2"], ["ios", "web"], datetime(2026, 1, 5), 0.3, 3)
    assert (got["h"].corroboration, got["h"].versions, got["h"].resolution_count) == (1, [], 0)


def test_json_keys_are_set(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, null]}, "signal": 1}',), ("{}",), (None,), ("no json",), ("[1]",)], "d string")
    got = [json.loads(r[0]) for r in df.select(T.set_json(F.col("d"), "signal", F.struct(F.lit("g").alias("id")))).collect()]
    assert got == [{"a": {"b": [1, None]}, "signal": {"id": "g"}}] + [{"signal": {"id": "g"}}] * 4


def test_reports(spark):
    e = spark.createDataFrame([(1, "c1", "e1"), (2, "c2", "e1"), (3, "c1", None), (4, None, "e2")], "id long, classifier_version string, embedder_version string")
    assert {r.id: r.reason for r in R.outdated(e, "c1", "e1").collect()} == {2: "classifier", 3: "embedder", 4: "both"}
    q = spark.createDataFrame([("a", "critical"), ("a", "critical"), ("b", "critical"), ("b", "low_confidence")], "id string, reason string")
    assert {r.reason: r.n_reviews for r in R.queue_report(q).collect()} == {"critical": 2, "low_confidence": 1}
    s = spark.createDataFrame([("up", 1.0, 1), ("up", 0.0, 2), ("n", None, 5)], "name string, value double, at int")
    assert {r.name: r.value for r in A.gauges(s, ["at"]).collect()} == {"up": 0.0, "n": None}
    m = spark.createDataFrame([(" Dark  Mode ", f"r{i:02}", i) for i in range(30)], "mention string, review_id string, ts int")
    (r,) = A.mention_candidates(m).collect()
    assert (r.normalized, r.n, r.first_seen, r.last_seen, r.examples) == ("dark mode", 30, 0, 29, [f"r{i:02}" for i in range(20)])
    p = A.overlaps_or_open(F.col("a"), F.col("b"))
    df = spark.createDataFrame([([], ["x"], True), (["x"], [], True), (["x"], ["y"], False), (["x", "z"], ["z"], True)], "a array<string>, b array<string>, want boolean")
    assert df.where(p != F.col("want")).count() == 0


def test_review_list_and_funnel(spark):
    rows = spark.createDataFrame([("s", "2", "f1", "bug"), ("s", "1", None, "bug"), ("s", "3", "f9", "ads")], "source string, source_id string, feature_id string, category string")
    rows = rows.withColumn("lang", F.struct(F.lit("en").alias("language"))).withColumn("c", F.struct("category", F.lit("neutral").alias("sentiment"), F.lit("low").alias("severity"))).withColumn("state", F.lit("grounded"))
    got = [(r.source_id, r.feature) for r in I.review_list(rows, spark.createDataFrame([("f1", "Pay")], "id string, label string")).collect()]
    assert got == [("3", None), ("1", None), ("2", "Pay")]
    out = spark.createDataFrame([("a", "classified"), ("b", "duplicate"), ("c", "classified")], "id string, status string")
    done = spark.createDataFrame([("a", True), ("c", False)], "id string, is_actionable boolean")
    asks = spark.createDataFrame([("c", "x"), ("c", "y")], "id string, reason string")
    r = R.funnel(out, done, asks).first()
    assert (r.n_in, r.n_duplicate, r.n_classified, r.n_actionable, r.n_human) == (3, 1, 2, 1, 1)
