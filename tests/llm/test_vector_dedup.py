import random

import numpy as np
import pytest

from siftloom.llm.vector_dedup import CapFilters, near_vectors


def brute(rows, cosine=0.95):
    ok = []
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            ok.append((k, np.array(v, float)))
    near = {k: {m for m, y in ok if m != k and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine} for k, x in ok}
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in near:
        for m in near[k]:
            a, b = sorted((find(rows[k][0]), find(rows[m][0])))
            root[b] = a
    return sorted(((i, len(near.get(k, ())), None if i is None else find(i), None if i is None else find(i) == i) for k, (i, _) in enumerate(rows)), key=str)


def turned(rng, x, cosine):
    z = rng.normal(size=len(x))
    z -= z @ x / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


@pytest.mark.parametrize("block", [1024, 7])
def test_equals_all_pairs_where_pairs_are_clear(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for c in rng.normal(size=(25, 24)):
        rows += [turned(rng, c, 0.998).tolist() for _ in range(int(rng.integers(1, 15)))]
    rows += [rows[0]] * 20 + [[2 * v for v in rows[3]], None, [0.0] * 24, [None] + rows[0][1:], [float("nan")] + rows[0][1:], [float("inf")] * 24, [], rows[0][:5], rows[0][:5]]
    rows = list(enumerate(rows)) + [(None, rows[0]), (3, rows[30])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n int").repartition(4)
    got = sorted((tuple(r) for r in near_vectors(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 64))
    rows = [(2 * k + s, (x if s == 0 else turned(rng, x, 0.9501)).tolist()) for k, x in enumerate(base) for s in (0, 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = sum(r.n_links for r in got) / 2
    assert found / 400 >= 0.97
    assert all(r.component_id in (r.vec_id, r.vec_id - 1) for r in got)


def test_list_decoding_finds_exactly_the_exceeding_filters():
    code = CapFilters.made(10, 6, 0.9)
    rng = np.random.default_rng(0)
    for x in rng.normal(size=(50, 10)):
        x /= np.linalg.norm(x)
        r = code.rotation @ x
        a, b = (book @ part for book, part in zip(code.books, np.array_split(r, 2), strict=True))
        total = a[:, None] + b[None, :]
        want = np.flatnonzero(total.ravel() >= code.threshold)
        assert code.decode(x).tolist() == (want.tolist() or [int(total.argmax())])


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lengths_that_underflow_or_overflow(spark):
    far = [[1e-170] * 8, [5.0, *[0.5] * 7], [*[0.5] * 7, 5.0]]
    big = [[1e200] * 8, [5e-324] * 8, [3e-320] * 7 + [2.9e-320], [1.7e308] * 8, [-1e200] * 8, [5e250, *[5e249] * 7], [0.0] * 8]
    rows = list(enumerate(far + big))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [np.array([v * 10.0**-300 for v in np.array(r, np.longdouble)]) for _, r in rows]
    unit = [v / np.sqrt((v * v).sum()) if v.any() else v for v in (v / max(abs(v).max(), np.longdouble(0) + np.finfo(np.longdouble).tiny) for v in x)]
    want = {i: sum(i != j and float(unit[i] @ unit[j]) >= 0.95 for j in range(len(rows))) for i in range(len(rows))}
    assert {r.vec_id: r.n_links for r in near_vectors(df).collect()} == want
    assert want[0] == 4 and want[1] == 1 and want[2] == 0
