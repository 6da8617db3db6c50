"""Groups of signals against a plain replay."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from siftloom.operators import signals as G
from siftloom.plans.tables import numbered, running

SCHEMA = "repo string, review_id string, created_at timestamp, is_defect boolean, canonical string, artifacts array<string>, vector array<double>"


def replay(reports):
    groups, out = {}, []
    for repo, rid, _, defect, canonical, artifacts, v in sorted(reports, key=lambda r: (r[2], r[1])):
        own, mine = groups.setdefault(repo, []), set(artifacts or ())
        cos = [float(np.dot(v, g["v"])) for g in own]
        nearest = lambda ids: max(ids, key=lambda i: (cos[i], -i), default=None)  # noqa: E731, B023
        if not defect:
            i = nearest(range(len(own)))
            if i is not None and cos[i] >= G.RESOLVE_COSINE:
                out.append((rid, own[i]["id"], "resolution", own[i]["n"]))
            continue
        fits = [i for i, g in enumerate(own) if not mine or not g["art"] or mine & g["art"]]
        same = [i for i in fits if canonical is not None and own[i]["canonical"] == canonical]
        i, how = nearest(fits), "embedding"
        if same:
            i, how = min(same, key=lambda i: (-own[i]["n"], i)), "error_signature"
        elif i is None or cos[i] < G.ASSIGN_COSINE:
            own.append({"id": rid, "v": v, "art": mine, "canonical": canonical, "n": 0})
            i, how = len(own) - 1, "new"
        own[i]["n"] += 1
        out.append((rid, own[i]["id"], how, own[i]["n"]))
    return sorted(out)


@pytest.fixture
def ranges(spark):
    """Small ranges stay apart, as those of a large table do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_a_replay(spark, ranges, seed):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    centres = rng.normal(size=(9, 6))
    rows = []
    for i in range(260):
        v = centres[pick.randrange(9)] + rng.normal(size=6) * pick.choice([0.1, 0.3, 0.5])
        at = datetime(2026, 5, 1) + timedelta(hours=pick.randrange(80))
        artifacts = pick.sample("ABCDEF", pick.choice([0, 1, 1, 2, 3])) if pick.random() < 0.9 else None
        rows.append((pick.choice(["app", "web"]), f"r{i:03d}", at, pick.random() < 0.8, pick.choice([None, "crash", "crash", "hang"]), artifacts, (v / np.linalg.norm(v)).tolist()))
    got = sorted(tuple(r) for r in G.assign_in_order(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = replay(rows)
    assert got == want and {w[2] for w in want} == {"new", "error_signature", "embedding", "resolution"}


def test_no_reports(spark):
    assert G.assign_in_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_and_running_sums(spark, ranges):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), k, rng.randrange(2)) for k in rng.sample(range(5000), 1000)]
    df = numbered(spark.createDataFrame(rows, "key string, k long, n int").repartition(7), "k")
    got = {r.k: r for r in df.collect()}
    assert [got[k].row for k in sorted(got)] == list(range(1000)) and len({r.bucket for r in got.values()}) > 1
    total = {"a": 0, "b": 0}
    sums = {r.k: r.before for r in running(df, "key", "k", "bucket", "n").collect()}
    for key, k, n in sorted(rows, key=lambda r: r[1]):
        assert sums[k] == total[key]
        total[key] += n
