"""Batches that know earlier ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftloom.operators import batches as B
from siftloom.operators import reviews as R
from siftloom.operators.similarity import first_come, hamming_codes
from siftloom.sources.store import Conflict, Runs, Store

RAW = "source string, source_id string, text string, title string, rating double, locale string, app_version string, platform string, author string, created_at timestamp, ingested_at timestamp, raw_payload string"


def raw(spark, rows):
    return spark.createDataFrame([("app", f"s{i:03d}", t, None, None, "en", "2.4.0", "ios", None, datetime(2026, 5, 1) + timedelta(hours=i), datetime(2026, 5, 1) + timedelta(hours=i), "{}") for i, t in rows], RAW)


def outcome(rows):
    return sorted((r.source_id, r.status, r.reason, r.category, r.duplicate_of and r.duplicate_of.split("\x1f")[-1], r.reuses and r.reuses.split("\x1f")[-1]) for r in rows)


def test_batches_equal_one_batch(spark, tmp_path):
    texts = ["login fails with an error message since version two because my saved password keeps being rejected quickly", "login is broken and shows an error", "please add a dark mode to the settings screen", "great app, works perfectly every day", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = rng.choice(texts).split()
        if rng.random() < 0.5 and len(words) > 3:
            words[rng.randrange(len(words))] += "s"
        rows.append((i, " ".join(words)))
    whole = R.process(raw(spark, rows))
    store = Store(spark, str(tmp_path))
    got = []
    for part in (rows[:20], rows[20:]):
        got += B.arrive(store, raw(spark, part)).outcomes.collect()
    want = outcome(whole.outcomes.collect())
    assert outcome(got) == want and outcome(store.read("outcomes").collect()) == want
    assert {s for _, s, *_ in want} == {"duplicate", "classified", "cache_hit", "dropped_prefilter"}
    n = sum(s in ("classified", "cache_hit") for _, s, *_ in want)
    assert store.read("processed").count() == store.read("embeddings").count() == n
    assert len(store.versions("outcomes")) == 2 and {r.status for r in Runs(spark, str(tmp_path)).table().collect()} == {"done"}
    # a batch that is overtaken publishes nothing
    plain = store.commit_all

    def late(*a, **k):
        store.commit_all = plain
        store.append("outcomes", store.read("outcomes").limit(0))
        return plain(*a, **k)

    store.commit_all = late
    with pytest.raises(Conflict):
        B.arrive(store, raw(spark, [(99, "something else entirely happens here")]))
    assert store.read("processed").count() == n and "failed" in {r.status for r in Runs(spark, str(tmp_path)).table().collect()}


def test_codes_in_batches(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = [(i, rng.choice(base) ^ sum(1 << rng.randrange(60) for _ in range(rng.randrange(4)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, simhash long")
    want = sorted((r.id, r.duplicate_of) for r in first_come(df, alike=hamming_codes(df)).collect())
    one, two = df.where("id < 90"), df.where("id >= 90")
    a = first_come(one, alike=hamming_codes(one))
    kept = a.where("duplicate_of is null").join(one, "id").select("id", F.col("simhash").alias("code"))
    b = first_come(two, alike=hamming_codes(two, known=kept), kept=kept)
    assert sorted((r.id, r.duplicate_of) for r in a.unionByName(b).collect()) == want
