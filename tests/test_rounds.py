"""Rounds over graphs, clusters of gaps, health, retries, languages, against plain versions."""

import random
from collections import Counter, deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.functions import languages as L
from siftloom.operators import analytics as A
from siftloom.operators import health as H
from siftloom.operators import insight as I
from siftloom.operators import retries as R


def test_impact_equals_a_search(spark):
    rng = random.Random(2)
    calls = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(7, 7), (1, 2), (2, 1), (None, 3), (3, None)] + [(i, 0) for i in range(20)]
    back = {}
    for s, d in calls:
        if s is not None and d is not None:
            back.setdefault(d, set()).add(s)
    df, sources = spark.createDataFrame(calls, "src long, dst long"), spark.createDataFrame([(i,) for i in (0, 1, 7, 12, 12, None, 99)], "id long")
    for most in (None, 2, 0):
        want = set()
        for s in (0, 1, 7, 12, 99):
            seen, todo = {s: 0}, deque([s])
            while todo:
                x = todo.popleft()
                for y in back.get(x, ()):
                    if y not in seen and (most is None or seen[x] < most):
                        seen[y] = seen[x] + 1
                        todo.append(y)
            want |= {(s, x, h) for x, h in seen.items() if h}
        got = [tuple(r) for r in A.impact(df, sources, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_trees_of_many_levels(spark):
    rows = [("r", "Root", None), ("a", "A", "r"), ("b", "B", "r"), ("a1", "x", "a"), ("a2", "y", "a"), ("a11", "deep", "a1"), ("a12", "deeper", "a1"), ("lost", "Lost", "gone"), ("c1", "c", "c2"), ("c2", "c", "c1"), ("s", "Second", None)]
    nodes = spark.createDataFrame(rows, "id string, label string, parent_id string")
    got = {r.id: (r.x, r.y) for r in I.tree_layout(nodes).collect()}
    # leaves from top to bottom: a11, a12, a2, b, lost (its path starts with L), s
    assert got == {"a11": (990, 58.0), "a12": (990, 116.0), "a1": (660, 87.0), "a2": (660, 174.0), "a": (330, 130.5), "b": (330, 232.0), "r": (0, 181.25), "lost": (330, 0.0), "s": (0, 290.0)}
    reviews = spark.createDataFrame([("a1", "defective"), ("a1", "grounded")], "feature_id string, state string")
    graph = {r.id: (r.depth, r.n_reviews, r.n_defective) for r in I.feature_graph(nodes, reviews).collect()}
    assert graph["a11"] == (3, 0, 0) and graph["a1"] == (2, 2, 1) and graph["lost"] == (1, 0, 0) and "c1" not in graph
    assert I.tree_layout(nodes.limit(0)).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_gap_clusters_are_bounded(spark, order):
    rng = np.random.default_rng(1)
    chain = [np.cos(i * 0.35) * np.eye(6)[0] + np.sin(i * 0.35) * np.eye(6)[1] for i in range(12)]  # each near the next, the ends far apart
    rows = [(f"g{i:02d}", "x", v.tolist()) for i, v in enumerate(chain)] + [(f"h{i:02d}", "y", rng.normal(size=6).tolist()) for i in range(40)] + [("none", "z", None)]
    gaps = spark.createDataFrame(rows[::order], "id string, label string, v array<double>")
    into = {r.id: r.merged_into for r in I.merge_gaps(gaps, 0.8).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v}
    heads = []
    for i in sorted(unit):
        near = [(-unit[i] @ unit[h], h) for h in heads if unit[i] @ unit[h] >= 0.8]
        assert into[i] == (min(near)[1] if near else None)
        heads += [] if near else [i]
    assert into["none"] is None and len({into[f"g{i:02d}"] for i in range(12)}) > 2


def test_health_merges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)) + np.repeat(np.arange(3), 30)[:, None]
    rows = [(int(i // 30), i % 4, v.tolist()) for i, v in enumerate(x)] + [(1, 0, None)]
    df = spark.createDataFrame(rows, "g int, day int, v array<double>")
    whole, parts = H.group_sums(df, ["g"]), H.merged_sums(H.group_sums(df, ["day", "g"]), ["g"])
    a, b = H.health(whole).first(), H.health(parts).first()
    within = np.mean(((x - x.reshape(3, 30, 5).mean(1).repeat(30, 0)) ** 2).sum(1))
    total = np.mean(((x - x.mean(0)) ** 2).sum(1))
    for r in (a, b):
        assert (r.n_groups, r.n) == (3, 90) and r["within"] == pytest.approx(within) and r.between == pytest.approx(total - within) and r.separation == pytest.approx(1 - within / total) and r.entropy == pytest.approx(1)
    assert {r.g: round(r["within"], 9) for r in H.group_variance(parts, "g").collect()} == {k: round(float(((y - y.mean(0)) ** 2).sum(1).mean()), 9) for k, y in enumerate(x.reshape(3, 30, 5))}
    assert H.health(H.group_sums(df.limit(0), ["g"])).count() == 0


def test_retries(spark):
    at = lambda minutes: F.lit(datetime(2026, 5, 1) + timedelta(minutes=minutes))
    rows = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", "ok"), ("b", "bad")], "id string, text string")
    state = spark.createDataFrame([("z", "other", 1, "h", None, "dead")], R.STATE)
    seen = []
    for minute in (0, 0.5, 1, 2, 3, 99):
        asked = R.due(rows, state, "s", at(minute))
        good, results = R.attempted(asked, F.upper("text"), F.when(F.col("text") == "bad", "no good"))
        seen.append((sorted(r.id for r in asked.collect()), sorted(r.value for r in good.collect())))
        state = spark.createDataFrame(R.recorded(state, results, "s", at(minute)).collect(), R.STATE)
    # a failing row neither stops nor repeats the others; it waits one minute, then two, and is dead after the third time
    assert seen == [(["a", "b", "b", "c"], ["OK", "OK"]), ([], []), (["b", "b"], []), ([], []), (["b", "b"], []), ([], [])]
    got = {r.id: (r.step, r.attempts, r.status, r.error_hash is not None, r.due) for r in state.collect()}
    assert got == {"a": ("s", 1, "done", False, None), "b": ("s", 3, "dead", True, None), "c": ("s", 1, "done", False, None), "z": ("other", 1, "dead", True, None)}


def test_triples_and_profiles(spark):
    df = spark.createDataFrame([("Ab, c!",), ("",), (None,), ("12 3",), ("é\U00010400z",)], "t string")
    got = [r[0] for r in df.select(L.triples(F.col("t"))).collect()]
    assert got == [[" ab", "ab ", "b c", " c "], [], [], [], [" é\U00010428", "é\U00010428z", "\U00010428z "]]
    texts = [("en", "the cat and the dog"), ("de", "der hund und die katze"), (None, "xx")]
    profiles = L.fit(spark.createDataFrame(texts, "lang string, text string"))
    rank = {}
    for lang, t in texts[:2]:
        t = f" {t} "
        n = Counter(t[i : i + 3] for i in range(len(t) - 2))
        rank[lang] = {g: i for i, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0])), 1)}
    assert {(r.lang, r.gram): r["rank"] for r in profiles.collect()} == {(k, g): i for k, v in rank.items() for g, i in v.items()}
    ask = spark.createDataFrame([(1, "the other dog"), (2, "und der andere hund"), (3, ""), (4, "안녕하세요 여러분"), (5, "hi")], "id long, text string")
    assert {r.id: r.language for r in L.by_triples(ask, profiles).collect()} == {1: "en", 2: "de"}
    assert {r.id: tuple(r.lang) for r in L.with_language(ask, profiles).collect()} == {1: ("en", 0.8), 2: ("de", 0.8), 3: ("en", 0.6), 4: ("ko", 0.95), 5: ("en", 0.6)}
    assert L.by_triples(ask, profiles.limit(0)).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    found = L.by_triples(docs.where(held), L.fit(docs.where(~held))).join(docs, "id")
    right, n = found.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert n > 150 and right >= 0.95 * n
