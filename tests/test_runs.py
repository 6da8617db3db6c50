"""From raw reviews to ranked proposals in one run."""

from datetime import datetime

from pyspark.sql import functions as F

from siftloom.operators.runs import from_reviews
from siftloom.sources.tables import RAW_REVIEW, seeded

FEATURES = [
    {"repo": "app", "id": "f-pay", "label": "Payment", "description": "card payment checkout", "parent_id": "code.payment", "module": "payment"},
    {"repo": "app", "id": "f-map", "label": "Map", "description": "map of shops", "parent_id": "code.map", "module": "map"},
]
ARTIFACTS = [
    {"repo": "app", "id": "m-pay", "kind": "module", "path": "src/payment", "module": "payment", "feature_ids": ["f-pay"]},
    {"repo": "app", "id": "x-map", "kind": "file", "path": "src/map/view.ts", "module": "map", "symbol": "MapView", "feature_ids": ["f-map"]},
]


def review(i, text, rating=1.0, day=1, author=None):
    return "store", f"s{i:03}", text, None, rating, "en", "2.4.0", "web", (author, None), datetime(2026, 5, day), datetime(2026, 5, day, 1, i), None


def run(spark, rows):
    f, a = seeded(spark, FEATURES, ARTIFACTS)
    edges = spark.createDataFrame([("x-map", "m-pay", "calls")], "src string, dst string, kind string")
    return from_reviews(spark.createDataFrame(rows, RAW_REVIEW), f, a, edges, F.lit("2026-05-26").cast("timestamp"))


def test_reviews_become_proposals(spark):
    rows = [
        review(1, "the payment screen crashes whenever i pay with my card", day=20, author="u1"),
        review(2, "crash on the payment page again, the card checkout closes", day=21, author="u2"),
        review(3, "the map freezes and is frozen every time it opens, error", day=22, author="u3"),
        review(4, "please add a zebra calendar, it would be nice to have such a feature", 4.0, 22, "u4"),
        review(5, "best app ever, love it, perfect", 5.0, 22, "u5"),
        review(6, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", 1.0, 22, "u6"),
    ]
    r = run(spark, rows)
    status = {x.source_id: x.status for x in r.batch.outcomes.collect()}
    assert status["s006"] == "dropped_prefilter" and status["s001"] == status["s002"] == "classified"
    own = {x.review_id: x.group_id for x in r.members.collect()}
    ids = {x.source_id: x.id for x in r.batch.outcomes.collect()}
    assert own[ids["s001"]] == own[ids["s002"]] == ids["s001"] and own[ids["s003"]] == ids["s003"]
    groups = {x.group_id: x.corroboration for x in r.groups.collect()}
    assert groups == {ids["s001"]: 2, ids["s003"]: 1}
    top = r.proposals.collect()
    kinds = {(p.kind, p.ref_id): p for p in top}
    pay = kinds["bug_fix", ids["s001"]]
    assert pay.target_module == "payment" and pay.priority > kinds["bug_fix", ids["s003"]].priority and pay.body.startswith("- the payment screen crashes")
    assert [p.priority for p in top] == sorted((p.priority for p in top), reverse=True)
    gaps = [p for p in top if p.kind == "feature_gap"]
    assert len(gaps) == 1 and gaps[0].placement == "new_module"
    assert own.keys() <= set(ids.values())


def test_an_empty_batch(spark):
    r = run(spark, [])
    assert r.proposals.count() == r.groups.count() == r.members.count() == r.batch.outcomes.count() == 0
