import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.functions.vectors import cosine, embedding_of, hamming, simhash_of
from siftloom.operators import analytics as A
from siftloom.operators import signals as G
from siftloom.operators.reviews import funnel, map_code, map_features, process
from siftloom.operators.similarity import first_come, hamming_codes, nearest
from siftloom.plans.tables import spread
from siftloom.sources.store import Store, memoised
from siftloom.sources.tables import RAW_REVIEW, validate


def test_embedder_and_hash(spark):
    a, b = embedding_of("The app crashes"), embedding_of("the  app crashes")
    assert np.isclose(a @ b, 1) and embedding_of("완전히 다른 문장") @ a < 0.5 and not embedding_of(None).any()
    assert simhash_of("") == simhash_of(None) == 0 and simhash_of("abc") == simhash_of(" ABC ")
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [None if r[0] is None else round(r[0], 4) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [None, 0.7071, None]


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8)).round(1).tolist()
    v[3] = [0.0] * 8
    v[5] = v[6]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    x = np.array(v)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    got = {}
    for r in nearest(df, df, 4, 0.1).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], round(r["cosine"], 9)))
    for i in range(120):
        s = [(-round(float(unit[i] @ unit[j]), 9), j) for j in range(120) if j not in (i, 3) and i != 3 and unit[i] @ unit[j] >= 0.1]
        assert sorted(got.get(i, [])) == [(k + 1, j, -c) for k, (c, j) in enumerate(sorted(s)[:4])]


def test_near_codes_equal_brute_force(spark):
    rng = random.Random(4)
    codes = [rng.getrandbits(64) for _ in range(15)]
    codes += [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for c in codes for _ in range(4)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([*enumerate(signed), (500, 0), (501, 0)], "id long, simhash long")
    alike = hamming_codes(df)
    rows = {r.id: r.code for r in alike.members.collect()}
    near = {(r.c1, r.c2): r.distance for r in alike.near.collect()}
    got = {(i, j, near[rows[i], rows[j]]) for i in rows for j in rows if i < j and (rows[i], rows[j]) in near}
    assert got == {(i, j, (codes[i] ^ codes[j]).bit_count()) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() <= 3}
    assert near == {(b, a): d for (a, b), d in near.items()}
    # 3,000 rows of one code make rows and one near code, not pairs
    many = hamming_codes(spark.range(3000).select("id", F.lit(77).cast("long").alias("simhash")))
    assert (many.members.count(), many.near.count()) == (3000, 1)
    assert {r.duplicate_of for r in first_come(spark.range(3000), alike=many).where("id > 0").collect()} == {0}
    assert spark.range(1).select(hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))).first()[0] == 64


def test_first_come_follows_the_order_of_arrival(spark):
    rng = random.Random(2)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a != b}
    pairs |= {(100, 101), (101, 102), (102, 103)}
    kept, want = [], {}
    ids = [*range(40), 100, 101, 102, 103]
    for i in ids:
        near = [a for a, b in pairs if b == i and a in kept]
        want[i] = min(near) if near else None
        if not near:
            kept.append(i)
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, distance int")
    assert {r.id: r.duplicate_of for r in first_come(rows, df).collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_come_replays_vectors_and_codes(spark, seed):
    """Against a plain replay: the nearest kept earlier row by cosine, else the nearest one by code."""
    rng = random.Random(seed)
    codes = [rng.getrandbits(63) | 1 for _ in range(12)]
    codes = [c ^ sum(1 << rng.randrange(63) for _ in range(rng.choice([0, 0, 1, 2, 3, 5]))) for c in (rng.choice(codes) for _ in range(160))]
    vectors = np.random.default_rng(seed).normal(size=(20, 6))
    vectors = [vectors[rng.randrange(20)] + np.random.default_rng(1000 * seed + i).normal(size=6) * rng.choice([0.01, 0.05, 0.3]) for i in range(160)]
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    cos = unit @ unit.T
    want, kept = {}, []
    for i in range(160):
        near = [(-cos[i, j], j) for j in kept if cos[i, j] >= 0.985] or [((codes[i] ^ codes[j]).bit_count(), j) for j in kept if (codes[i] ^ codes[j]).bit_count() <= 3]
        want[i] = min(near)[1] if near else None
        if not near:
            kept.append(i)
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(vectors, codes, strict=True))], "id long, v array<double>, simhash long").repartition(3)
    pairs = nearest(df, df, None, 0.985, earlier=True).select(F.col("id").alias("a"), F.col("query").alias("b"), (-F.col("cosine")).alias("distance"))
    assert {r.id: r.duplicate_of for r in first_come(df, pairs, alike=hamming_codes(df)).collect()} == want
    assert 20 < len(kept) < 150


def test_spread(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 3), (None, 1)] + [(i, i + 1) for i in range(20, 50)]
    got = {r.node: r.root for r in spread(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8} | {i: 20 for i in range(20, 51)}


def group(i, canonical, artifacts, day):
    return i, canonical, artifacts, datetime(2026, 5, day)


@pytest.mark.parametrize(("artifacts", "n"), [([["A"], ["B"], ["A", "B"]], 1), ([["A"], ["B"]], 2), ([[], ["B"]], 1), ([["A"], None, ["C"]], 1)])
def test_reconcile(spark, artifacts, n):
    rows = [group(f"g{i}", "crash", a, 9 - i) for i, a in enumerate(artifacts)] + [group("x", "hang", ["A"], 1), group("y", None, ["A"], 1)]
    for order in (rows, rows[::-1]):
        keep = {r.id: r.keep for r in G.reconcile(spark.createDataFrame(order, "id string, canonical string, artifacts array<string>, first_seen timestamp")).collect()}
        assert len({keep[f"g{i}"] for i in range(len(artifacts))}) == n and keep["x"] == "x" and keep["y"] == "y"
        assert n > 1 or keep["g0"] == f"g{len(artifacts) - 1}"


def test_signals_in_order(spark):
    v = lambda t: embedding_of(t).tolist()
    rows = [
        ("app", "r1", 1, True, "crash", ["A"], v("app crashes on start")), ("app", "r2", 2, True, "crash", ["A", "B"], v("totally different words")), ("app", "r3", 3, True, "crash", ["C"], v("another module dies")),
        ("app", "r4", 4, True, None, [], v("app crashes on start")), ("app", "r5", 5, False, None, [], v("app crashes on start")), ("app", "r6", 6, False, None, [], v("no relation at all")), ("web", "r7", 1, True, "crash", ["A"], v("app crashes on start")),
    ]
    df = spark.createDataFrame([(a, b, datetime(2026, 5, d), e, c, f, g) for a, b, d, e, c, f, g in rows], "repo string, review_id string, created_at timestamp, is_defect boolean, canonical string, artifacts array<string>, vector array<double>")
    got = {r.review_id: (r.group_id, r.matched_by, r.corroboration) for r in G.assign_in_order(df).collect()}
    assert got == {"r1": ("r1", "new", 1), "r2": ("r1", "error_signature", 2), "r3": ("r3", "new", 1), "r4": ("r1", "embedding", 3), "r5": ("r1", "resolution", 3), "r7": ("r7", "new", 1)}
    by = {r.review_id: r.root for r in G.assign_by_key(df).collect()}
    assert by["r1"] == by["r2"] and by["r3"] != by["r1"] and by["r7"] == "r7"


def review(i, text, rating=None, day=1):
    return ("app_store", f"s{i:03d}", text, None, rating, "ko", "2.4.0", "ios", None, datetime(2026, 5, day), datetime(2026, 5, day, 1), "{}")


def test_review_pipeline(spark):
    rows = [review(1, "결제할 때 앱이 튕기고 강제종료됩니다", 1.0), review(2, "결제할 때 앱이 튕기고 강제종료됩니다", 1.0), review(3, "a" * 24), review(4, "최고의 앱이에요 완벽합니다", 5.0), review(5, "정말 불편하고 별로네요 hong@x.com", 2.0)]
    raw = spark.createDataFrame(rows, RAW_REVIEW)
    features = spark.createDataFrame([("f-pay", "Payment", "결제 화면", embedding_of("결제").tolist()), ("f-map", "Map", "지도", embedding_of("지도").tolist())], "id string, label string, description string, v array<double>")
    b = process(raw, features)
    got = {r.source_id: r for r in b.outcomes.collect()}
    assert [got[f"s00{i}"].status for i in range(1, 6)] == ["classified", "duplicate", "dropped_prefilter", "classified", "classified"]
    assert got["s001"].category == "bug" and got["s004"].category == "praise" and got["s002"].duplicate_of == got["s001"].seq
    p = {r.source_id: r for r in b.processed.collect()}
    assert p["s001"].feature_id == "f-pay" and p["s001"].state == "defective" and p["s001"].canonical == "crash" and p["s001"].is_actionable
    assert p["s005"].state == "gap" and p["s005"].feature_id.startswith("gap:app:") and "<EMAIL>" in p["s005"].text_redacted
    assert {r.reason for r in b.queue.collect()} >= {"feature_gap"}
    assert tuple(funnel(b.outcomes).first()) == (5, 1, 1, 0, 3)
    again = process(raw.orderBy(F.desc("source_id")), features).outcomes
    assert {(r.source_id, r.status) for r in again.collect()} == {(k, r.status) for k, r in got.items()}


def test_semantic_reuse_is_transitive(spark):
    from siftloom.operators.reviews import reuse

    base = np.zeros(8)
    base[0] = 1
    at = lambda d: (np.array([np.cos(d), np.sin(d)] + [0] * 6)).tolist()
    rows = [("a", at(0.0), 0.9), ("b", at(0.2), 0.9), ("c", at(0.4), 0.9), ("d", at(1.5), 0.9), ("e", at(1.55), 0.5), ("f", at(1.6), 0.5)]
    df = spark.createDataFrame(rows, "seq string, v array<double>, k double").withColumn("c", F.struct(F.col("k").alias("category_confidence")))
    assert {r.seq: r.reuses for r in reuse(df).collect()} == {"b": "a", "c": "a", "e": "d", "f": "d"}


def test_shortlist_and_code_mapping(spark):
    feats = [(f"f{i}", f"Feature {i}", f"words {i}", embedding_of(f"feature {i}").tolist()) for i in range(150)] + [("chart", "StockGraph", "chart", embedding_of("chart does not show").tolist())]
    features = spark.createDataFrame(feats, "id string, label string, description string, v array<double>")
    kept = spark.createDataFrame([("1", "chart does not show", embedding_of("chart does not show").tolist(), "bug", None, ["x"])], "seq string, text_redacted string, v array<double>, k string, area string, mentions array<string>").withColumn("c", F.struct(F.col("k").alias("category")))
    assert map_features(kept, features, "app").first().feature_id == "chart"
    arts = spark.createDataFrame([("m1", "module", "app", ["chart"], None), ("f1", "file", "a.ts", ["chart"], None), *[(f"g{i}", "file", f"p{i}.ts", ["other"], None) for i in range(9)], ("s", "symbol", "z", [], embedding_of("결제 화면").tolist())], "id string, kind string, path string, feature_ids array<string>, v array<double>")
    defects = spark.createDataFrame([("1", "chart", None), ("2", "other", "결제 화면")], "seq string, feature_id string, area string")
    got = {(r.seq, r.artifact_id, r.source) for r in map_code(defects, arts).collect()}
    assert got == {("1", "m1", "feature_link"), ("2", "s", "semantic_match")} | {("2", f"g{i}", "feature_link") for i in range(6)}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(x, "k string, seq int, first string, last string")
    s.upsert("t", rows(("a", 1, "x", "x"), ("a", 2, "y", "y"), ("b", 1, "z", "z")), ["k"], ["seq"])
    s.upsert("t", rows(("a", 3, "new", "new"), ("c", 1, "c", "c")), ["k"], ["seq"], keep=("first",))
    assert sorted(map(tuple, s.read("t").select("k", "first", "last").collect())) == [("a", "y", "new"), ("b", "z", "z"), ("c", "c", "c")]
    bad = s.read("t").withColumn("last", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        s.commit("t", bad)
    assert s.read("t").count() == 3 and len(s.versions("t")) == 2
    s.replace_where("t", F.col("k") == "a", rows(("d", 1, "d", "d")))
    s.append("t", rows(("e", 1, "e", "e")))
    assert sorted(r.k for r in s.read("t").collect()) == ["b", "c", "d", "e"]
    assert s.read("none", "k string").count() == 0


def test_memo_runs_only_for_what_changed(spark):
    cache = spark.createDataFrame([], "id long, hash string, output string")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, input string")
    seen = []

    def stage(d):
        seen.append(d.count())
        return d.withColumn("output", F.upper("input"))

    _, fresh = memoised(df, cache, stage)
    out, _ = memoised(df.withColumn("input", F.when(F.col("id") == 2, "c").otherwise(F.col("input"))), fresh, stage)
    memoised(df, fresh, stage, version="v2")
    assert seen == [2, 1, 2] and sorted(r.output for r in out.collect()) == ["A", "C"]


def test_validation(spark):
    rows = [review(1, "ok", 5.0), review(2, "", 5.0), review(3, "x", 6.0), review(4, None)]
    good, bad = validate(spark.createDataFrame(rows, RAW_REVIEW))
    assert good.count() == 1 and bad.count() == 3


def test_drift_and_demand(spark):
    d = lambda *x: spark.createDataFrame([("lang", b, n) for b, n in x], "dimension string, bucket string, n long")
    same, other = d(("ko", 19), ("en", 1)), d(("ko", 1), ("en", 19))
    assert A.psi(same, same).first().drift == "stable" and A.psi(same, other).first().psi > 0.25
    reports = spark.createDataFrame([("f", "u1", None, "1"), ("f", "u1", None, "2"), ("g", "u2", None, "3"), ("h", None, None, "4"), ("h", None, None, "5")], "feature_id string, author_id string, author_name string, source_id string")
    feats = spark.createDataFrame([("f", None), ("g", "f"), ("h", None), ("i", None)], "id string, merged_into string")
    assert {r.canon: r.demand for r in A.demand(reports, feats).collect()} == {"f": 2, "h": 2, "i": 0}
    vals = spark.createDataFrame([("a", x) for x in (0.6, 0.8, 0.9, 0.95)], "k string, v double")
    r = A.nearest_rank(vals, "k", "v", {"p50": 0.5}).first()
    assert r.n == 4 and r.p50 == 0.9 and r["mean"] == 0.813


def test_events_and_module_summary(spark):
    a = spark.createDataFrame([("r1", "g", "new", 1), ("r2", "g", "embedding", 2), ("r3", "g", "resolution", 2)], "review_id string, group_id string, matched_by string, corroboration long")
    k = spark.createDataFrame([("g", "g"), ("h", "g")], "id string, keep string")
    assert [(r.group_id, r.event_type) for r in G.events(a, k).collect()] == [("g", "CREATED"), ("g", "MEMBER_ADDED"), ("g", "STATUS_CHANGED"), ("h", "MERGED")]
    arts = spark.createDataFrame([("m", "file", "low"), ("m", "symbol", "high"), ("m", "symbol", "medium"), ("n", "file", "low")], "module string, kind string, risk_tier string")
    assert {tuple(r) for r in A.module_summary(arts).collect()} == {("m", 1, 2, 2), ("n", 1, 0, None)}
    assert [r.id for r in A.feature_list(spark.createDataFrame([("1", "b"), ("2", "a")], "id string, label string"), 1).collect()] == ["2"]


def test_mentions(spark):
    from siftloom.operators.reviews import match_mentions

    f = spark.createDataFrame([("f1", "Checkout", ["결제"], embedding_of("checkout").tolist()), ("f2", "Search box", None, embedding_of("search box").tolist())], "id string, label string, aliases array<string>, v array<double>")
    m = spark.createDataFrame([("r", " 결제 "), ("r", "결제"), ("r", "SEARCH  BOX"), ("r", "something else"), ("r", ""), ("q", "checkout")], "id string, mention string")
    got = {(r.id, r.mention): (r.feature_id, r.score, r.status) for r in match_mentions(m, f).collect()}
    assert got == {("r", "결제"): ("f1", 1.0, "auto_verified"), ("r", "SEARCH  BOX"): ("f2", 1.0, "auto_verified"), ("r", "something else"): (None, got["r", "something else"][1], "unmatched"), ("q", "checkout"): ("f1", 1.0, "auto_verified")}


def test_decisions(spark):
    from siftloom.operators.insight import decide

    p = spark.createDataFrame([("app", "bug_fix", "1", "t")], "repo string, kind string, ref_id string, title string")
    q = spark.createDataFrame([("app", "bug_fix", "1", "approved", None, "me", 1), ("app", "bug_fix", "1", "rejected", "no", "me", 2), ("app", "bug_fix", "2", "approved", None, "me", 1), ("app", "bug_fix", "1", "approved", "x" * 2001, "me", 9), ("app", "bug_fix", None, "approved", None, "me", 1)], "repo string, kind string, ref_id string, decision string, note string, decided_by string, at int")
    good, bad = decide(p, q)
    assert [(r.decision, r.title_snap) for r in good.collect()] == [("rejected", "t")] and bad.count() == 3


def _at(angle):
    return [float(np.cos(angle)), float(np.sin(angle))]


def test_duplicate_with_five_nearer_later_reviews(spark):
    from siftloom.operators.reviews import duplicates

    rows = [("a", _at(0.0)), ("b", _at(0.16))] + [(f"c{i}", _at(0.1601 + i / 1e4)) for i in range(6)] + [(f"d{i}", _at(0.001 + i / 1e4)) for i in range(6)]
    df = spark.createDataFrame([(s, v, 0) for s, v in rows], "seq string, v array<double>, simhash long")
    assert {r.seq: r.duplicate_of for r in duplicates(df).collect()} == {s: None if s == "a" else "a" for s, _ in rows}


def test_reuse_with_twenty_nearer_later_reviews(spark):
    from siftloom.operators.reviews import reuse

    rows = [("a", _at(0.0)), ("b", _at(0.2))] + [(f"c{i:02d}", _at(0.2001 + i / 1e4)) for i in range(21)]
    df = spark.createDataFrame([(s, v, 0.9) for s, v in rows], "seq string, v array<double>, k double").withColumn("c", F.struct(F.col("k").alias("category_confidence")))
    assert {r.seq: r.reuses for r in reuse(df).collect()} == {s: "a" for s, _ in rows[1:]}
