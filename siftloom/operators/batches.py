"""Reviews that arrive in batches: each is decided against all that earlier ones kept.

A store holds three tables: ``outcomes`` (what became of every review), ``processed`` (kept reviews) and
``embeddings`` (their vectors with the list that they are in, and codes), and ``centroids`` of the lists.
A batch is one commit of all of them, so its reviews, vectors and outcomes show together or not at all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Runs, Store
from . import reviews as R
from .index import assigned, fit, of_rows

#: Lists are fitted anew when they have so many times the rows that they were made for.
REFIT = 4


def known(store: Store) -> R.Known | None:
    """What the batches in ``store`` kept; None before the first one."""
    if not store.exists("outcomes"):
        return None
    rows = store.read("embeddings")
    centroids = np.array([r.v for r in store.read("centroids").orderBy("list").collect()], dtype=np.float64)
    return R.Known(of_rows(rows.select("list", "id", "v", "angle"), centroids), rows.select("id", F.col("simhash").alias("code")), store.read("processed"), len(store.versions("outcomes")))


def arrive(store: Store, raw: DataFrame, features: DataFrame | None = None, repo: str = "app") -> R.Batch:
    """Process a batch against all earlier ones and publish it; a run row says how it ended.

    Batches give what one batch of all of them gives if each arrives after those before it. A batch that
    fails publishes nothing. If another batch was published meanwhile, ``Conflict`` is raised: process it again.
    """
    spark = store.spark
    tables = ("outcomes", "processed", "embeddings", "centroids")
    with Runs(spark, store.root).run("batch"):
        after = {t: next(iter(store.versions(t)[-1:]), "") for t in tables}
        old = known(store)
        # the first batch is numbered like the others, so that reviews of all batches are ordered
        first = R.Known(of_rows(assigned(_none(spark), np.zeros((0, 0))), np.zeros((0, 0))), spark.createDataFrame([], "id string, code long"), None, 0)
        batch = R.process(raw, features, repo, old or first)
        new = batch.processed.select(F.col("seq").alias("id"), "v", "simhash")
        n_old, n_lists = (store.read("embeddings").count(), len(old.index.centroids)) if old else (0, 0)
        grown = n_old + new.count() > REFIT * R.PER_LIST * max(n_lists, 1) or not n_lists
        all_rows = store.read("embeddings").select("id", "v", "simhash").unionByName(new.select("id", F.col("v").cast("array<double>").alias("v"), "simhash")) if old else new
        centroids = fit(all_rows, per_list=R.PER_LIST) if grown else old.index.centroids
        rows = all_rows if grown else new
        placed = assigned(rows, centroids).join(rows.select("id", "simhash"), "id", "right").select("id", F.coalesce("list", F.lit(-1)).alias("list"), "v", "angle", "simhash")
        lists = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, v array<double>")
        store.commit_all(
            {"outcomes": batch.outcomes, "processed": batch.processed.select("id", "seq", "eligible", "is_actionable", *R.OWN), "embeddings": placed, "centroids": lists},
            after, keep=("outcomes", "processed") if grown else ("outcomes", "processed", "embeddings"),
        )
    return batch


def _none(spark) -> DataFrame:
    return spark.createDataFrame([], "id string, v array<double>")
