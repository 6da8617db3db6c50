import random
import zlib

import pytest

import numpy as np

from siftloom.llm.q_quality_classifier import op7_quality_classifier
from siftloom.llm.quality_classifier import DENSE, WORD_BITS, Machine, features, fit, score, train

GOOD, BAD = "the river runs over old stones and people walk along it".split(), "buy cheap now click win".split()


def made(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        y = int(rng.random() < 0.7)
        words = [rng.choice(GOOD if y or rng.random() < 0.3 else BAD) + ("" if y else "!!") for _ in range(rng.randint(30, 80))]
        yield i, " ".join(words), y


def test_held_out_accuracy_and_row_shapes(spark):
    rows = list(made(400, 1))
    docs = spark.createDataFrame([(i, t, len(t), "en", 0.5) for i, t, _ in rows] + [(None, None, None, None, None), (7, "", 0, None, None)], "doc_id long, text string, n_chars long, lang string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    machine = train(docs, labels)
    out = score(docs, machine).collect()
    assert len(out) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    y = {i: q for i, _, q in rows}
    held = [r for r in out if r.doc_id is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert score(docs.limit(0), machine).count() == 0
    # labels of held-out rows never reach the fit
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    assert [r.score for r in score(docs, train(docs, flipped)).collect()] == [r.score for r in out]


def test_sum_of_squares_identity():
    m = fit([(t, None, y) for _, t, y in made(60, 2)])
    i, x = features("the Cheap river river 12 #", None)
    pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert np.isclose(m.logit(i, x), m.w0 + m.w[i] @ x + pairs)


def test_without_labels_every_text_gets_the_prior(spark):
    assert fit([]).score(None, None) == fit([]).score("any text", 3) == 0.5
    assert fit([("a", 1, 1)]).score("b", 1) > 0.5


def test_query_on_given_tables(spark):
    """The registered query decides nearly all labels that were held out as they are marked."""
    sf = "/root/testdata/sf0.01"
    rows = op7_quality_classifier(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    held = [(r.predicted, r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 20 and np.mean([p == y for p, _, y in held]) >= 0.95
    good, bad = [s for _, s, y in held if y], [s for _, s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


@pytest.mark.parametrize("into", [("score", "predicted"), ("__a", "__b")])
def test_long_texts_ties_and_absent_columns(spark, into):
    """The bound of 0.3 counts as 1; a text of 300,000 distinct words has no more features than others can have."""
    long = " ".join(f"w{i}" for i in range(300_000))
    assert len(features(long, None)[0]) <= DENSE + (1 << WORD_BITS)
    size = DENSE + (1 << WORD_BITS)
    logit = float(np.log(0.3 / 0.7))
    tie = Machine(np.nextafter(logit, 1), np.zeros(size), np.zeros((size, 1)))
    docs = spark.createDataFrame([(1, "a", 0.9), (2, long, 0.8), (None, None, None)], "doc_id long, text string, score double")
    got = score(docs, tie, into=into).collect()
    assert {r[into[1]] for r in got} == {1} and all(abs(r[into[0]] - 0.3) < 1e-9 for r in got)
    assert into[0] == "score" or [r.score for r in got] == [0.9, 0.8, None]
    below = Machine(logit - 1e-9, np.zeros(size), np.zeros((size, 1)))
    assert {r[into[1]] for r in score(docs, below, into=into).collect()} == {0}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert train(docs, labels).w.shape == (size,)
