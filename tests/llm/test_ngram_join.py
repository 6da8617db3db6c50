import random
import re
from itertools import combinations

import numpy as np
import pytest

from siftloom.llm import ngram_join
from siftloom.llm.common import components
from siftloom.llm.ngram_join import Similarity, shingles, similar_components


def brute(rows, sim):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(sim.words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, (a, _)), (j, (b, _)) in combinations(enumerate(rows), 2):
        both = len(sets[i] & sets[j])
        if a is not None and b is not None and both and sim.den * both >= sim.num * len(sets[i] | sets[j]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted(((d is None, d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("seed", "sim", "hot", "flush"), [(1, Similarity(4, 85, 100), 32, 10**6), (2, Similarity(), 32, 300), (3, Similarity(4, 85, 100), 2, 200), (4, Similarity(5, 80, 100), 1, 50), (5, Similarity(1, 50, 100), 2, 10**6)])
def test_components_equal_brute_force(spark, monkeypatch, seed, sim, hot, flush):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "FLUSH_KEYS", flush)
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 8, 14, 20, 40, 90, 300]))] for _ in range(25)]
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(320):
        w = rng.choice(base)
        w = edited(rng, w, rng.choice([0, 0, 1, 2, 4, 1 + len(w) // 15]))
        if rng.random() < 0.4:
            w = (w + passage) if rng.random() < 0.5 else passage + w[: rng.randrange(12)]
        rows.append((i, " ".join(w).title() if rng.random() < 0.2 else "\n ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "A b"), (904, "a\x0bB"), (905, "b a"), (None, rows[0][1]), (3, rows[40][1]), (906, rows[5][1]), (906, rows[5][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, id int, key int").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in similar_components(df, sim).collect()), key=str)
    assert got == brute(rows, sim)


def test_empty_table(spark):
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_blocks_bound_the_difference():
    sim, rng = Similarity(4, 85, 100), random.Random(9)
    for _ in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 15, 30, 100, 500]))]
        x, y = shingles(" ".join(w), 4), shingles(" ".join(edited(rng, w, 1 + len(w) // 60)), 4)
        both = len(np.intersect1d(x, y))
        apart = sum(int(a ^ b).bit_count() for a, b in zip(ngram_join.folded(x).view(np.uint64), ngram_join.folded(y).view(np.uint64)))
        assert apart <= len(x) + len(y) - 2 * both
        if 100 * both >= 85 * (len(x) + len(y) - both):
            assert np.intersect1d(sim.keys(x)[0], sim.keys(y)[0]).size


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(50)] + [(None, 3), (7, None), (200, 200), (300, 299), (299, 300)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 41)} | {(100 + i, 100) for i in range(50)} | {(299, 299), (300, 299)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_passage_that_5000_unlike_texts_share(spark):
    """Texts that share a passage alone stay apart, near copies among them meet; and a very long text."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(5000)]
    rows += [(9000 + i, rows[i][1] + " end") for i in range(0, 60)]
    long = " ".join(f"v{rng.randrange(10**7)}" for _ in range(150_000))
    rows += [(20000, long), (20001, long + " more")]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Similarity(4, 85, 100)).collect()}
    assert all(got[i] == i for i in range(5000)) and all(got[9000 + i] == i for i in range(60)) and got[20001] == 20000


def test_what_similar_sets_leave_out_is_covered():
    """Whatever blocks two similar sets leave out, hot ones included, they keep one that both have."""
    rng = random.Random(12)
    for sim in (Similarity(4, 85, 100), Similarity(5, 80, 100), Similarity(1, 50, 100)):
        for _ in range(400):
            h = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.choice([2, 3, 5, 8, 13, 30, 80, 300]))], np.uint64))
            most = sim.most_apart(len(h))
            drop = rng.randrange(most + 1) if most else 0
            g = np.unique(np.r_[rng.sample(list(h), len(h) - drop // 2) if drop // 2 < len(h) else h, [np.uint64(rng.getrandbits(64)) for _ in range(drop - drop // 2)]].astype(np.uint64))
            both = len(np.intersect1d(h, g))
            if sim.den * both < sim.num * (len(h) + len(g) - both):
                continue
            (kh, sh), (kg, sg) = sim.keys(h), sim.keys(g)
            shared = np.intersect1d(kh, kg)
            band = min(sim.bands_of(len(h))[0], sim.bands_of(len(g))[0])
            shared = shared[(shared & np.uint64(0xFF)) == band]
            covered = max(dict(sh)[band], dict(sg)[band])  # so many of them may be hot for either
            assert len(shared) > covered
