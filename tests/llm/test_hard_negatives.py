import random

import numpy as np
import pytest

from siftloom.llm import hard_negatives as hn
from siftloom.llm.hard_negatives import mine


def brute(rows, every=100, positives=5, negatives=5, floor=80, scale=256):
    ok = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v and all(np.isfinite(v)):
            ok.append((i, label, tuple(int(np.floor(scale * x)) for x in v)))
    ok = list(set(ok))
    out = []
    for a in ok:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b) for b in ok if b is not a and len(b[2]) == len(a[2])]
        scored.sort(key=lambda s: s[:2])
        for s, p, _ in [x for x in scored if x[2][1] == a[1]][:positives]:
            bad = [(n, t) for t, n, b in scored if b[1] != a[1] and floor * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a[0], p, k, n, -s, -t) for k, (n, t) in enumerate(bad, 1)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, i, "c") for i, r in enumerate(rows)], "vec_id long, label int, embedding array<double>, score int, chunk string").repartition(3)
    out = mine(df, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture
def sizes(monkeypatch):
    """Many blocks, chunks and parts; the query's own test has the sizes of production."""
    for name, n in (("BLOCK", 16), ("CHUNK", 7), ("PART", 3)):
        monkeypatch.setattr(hn, name, n)


def test_equals_all_pairs(spark, sizes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(420):
        v = centres[i % 12] + rng.normal(size=16) * 0.5
        rows.append((i, int(rng.integers(0, 4)), (v / np.linalg.norm(v)).tolist()))
    # copies, a label of two rows, one of a single row, zero and tiny vectors, another length, rows that take no part
    rows += [(1000 + 10 * k, k % 3, rows[0][2]) for k in range(40)]
    rows += [(2000, 9, rows[5][2]), (2001, 9, rows[6][2]), (2100, 8, rows[7][2]), (2200, 1, [0.0] * 16), (2300, 2, [1e-170] * 16), (2400, 2, [-1e-170] * 16)]
    rows += [(2500 + k, k % 2, rows[k][2][:5]) for k in range(20)] + [(2600, 0, []), (2700, 1, [])]
    rows += [(None, 1, rows[0][2]), (3000, None, rows[0][2]), (3100, 1, None), (3200, 1, [None] * 16), (3300, 2, [float("nan")] * 16), (3400, 2, [float("inf")] * 16)]
    rows += [rows[0], rows[100], rows[100]]
    random.Random(3).shuffle(rows)
    assert got(spark, rows, anchors="vec_id % 10 = 0") == brute(rows, 10)


def test_repeated_ids_and_other_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 60, int(rng.integers(0, 3)), rng.integers(-2, 3, size=4).astype(float).tolist()) for i in range(140)]
    rows = [(i, label, v) for i, label, v in rows if i % 20 or label == 0]
    want = brute(rows, 20, 3, 2, 50, 1)
    # ties of one key are told apart by a hash, so keys are left out where they repeat
    some = got(spark, rows, anchors="vec_id % 20 = 0", positives=3, negatives=2, floor=50, scale=1)
    assert sorted((r[0], r[2], r[4], r[5]) for r in some) == sorted((r[0], r[2], r[4], r[5]) for r in want)


def test_products_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.integers(-(10**8), 10**8, size=8) + 0.5).tolist()) for i in range(200)]
    assert got(spark, rows, anchors="vec_id % 50 = 0", scale=1) == brute(rows, 50, scale=1)
    with pytest.raises(ValueError):
        got(spark, [*rows, (1, 1, [1e200] * 8)])


def test_near_anchors_read_few_blocks(spark, monkeypatch):
    """Tight clusters: an anchor's radius reaches its own cluster, and only blocks there are read."""
    monkeypatch.setattr(hn, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 24))
    rows = []
    for i in range(4000):
        v = centres[i % 20] + rng.normal(size=24) * 0.02
        rows.append((i, (i // 20) % 2, (v / np.linalg.norm(v)).tolist()))
    seen = []
    plain = hn.forget
    monkeypatch.setattr(hn, "forget", lambda t: (seen.append(t.count()) if t.columns == ["chunk", "part", "block"] else None, plain(t)))
    monkeypatch.setattr(hn, "CHUNK", 1)
    assert got(spark, rows, anchors="vec_id % 400 = 0") == brute(rows, 400)
    assert sum(seen) < 0.5 * 10 * 250


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, 1, [1.0])]) == []
    assert got(spark, [(100, 1, [1.0])]) == []
    assert got(spark, [(None, None, None)]) == []
