import pyarrow as pa

from siftloom.llm import common
from siftloom.llm.common import BATCH_ROWS, in_arrow, new_path, sent_if_small, written


def test_small_batches_leave_the_session_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    out = in_arrow(spark.range(5000).repartition(2), sizes, "n long")
    got = [r.n for r in out.collect()]
    assert max(got) <= BATCH_ROWS and sum(got) == 5000 and spark.conf.get(name) == before
    assert spark.range(5000).coalesce(1).mapInArrow(sizes, "n long").count() == 1
    # other settings are taken over, and there is one copy of the session
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert in_arrow(spark.range(10).groupBy("id").count(), sizes, "n long").sparkSession is spark
    plan = in_arrow(spark.range(10).repartition("id"), sizes, "n long")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ", 3)" in plan and len(common._COPIES) == 1
    # the result joins, and is written, like any other table
    both = out.join(spark.range(300).withColumnRenamed("id", "n"), "n")
    assert written(both, "t").count() == len(got)


def test_tables_are_sent_up_to_rows_and_bytes(spark, monkeypatch):
    few = written(spark.range(100), "t")
    plan = lambda df: df._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in plan(sent_if_small(few)) and "broadcast" not in plan(sent_if_small(few, 99))
    monkeypatch.setattr("siftloom.llm.common.MOST_SENT_BYTES", 10)
    assert "broadcast" not in plan(sent_if_small(few))
    assert new_path(spark, "a") != new_path(spark, "a")


def test_stages_leave_only_what_their_results_read(spark, tmp_path, monkeypatch):
    """Intermediate tables of a stage are deleted before the next one runs."""
    import corpus_pipeline

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(1, "a b c d e f\nown line"), (2, "A b c d e f\nother words"), (3, None)], "doc_id long, text string")
    for stage, kept in ((corpus_pipeline.lines, {"gone"}), (corpus_pipeline.near_duplicates, {"again", "gone"})):
        out = stage(spark, docs, "")
        assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == kept
        assert out.count() == 3
        for p in tmp_path.iterdir():
            p.rename(p.parent.parent / f"{p.name}-old")


def test_rows_are_picked_in_slices_without_a_shuffle(spark, monkeypatch):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    ids = written(spark.range(0, 2000, 7).withColumnRenamed("id", "k"), "t")
    want = list(range(0, 1000, 7))
    for most, slices, shuffled in ((1000, 4, False), (100, 4, False), (10, 4, True)):
        monkeypatch.setattr(common, "MOST_SENT_IDS", most)
        monkeypatch.setattr(common, "MOST_SLICES", slices)
        got = common.picked(rows, ids, "k")
        assert sorted(r.k for r in got.collect()) == want
        assert ("broadcast" not in got._jdf.queryExecution().logical().toString().lower()) == shuffled


def test_pairs_of_many_shared_keys_are_made_few_times_and_none_is_lost(spark):
    from pyspark.sql import functions as F

    from siftloom.llm.common import few_of, once

    rows = [(i, [k for k in range(60) if (k * 7 + i) % 10]) for i in range(12)] + [(90, [5, 70]), (91, [70, 71])]
    keys = spark.createDataFrame(rows, "id long, keys array<long>").select("id", few_of(F.col("keys")).alias("few"), F.explode("keys").alias("key"))
    all_pairs = keys.alias("x").join(keys.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")))
    some = all_pairs.where(once("x.key", "x.few", "y.few")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    assert set(some.collect()) == set(all_pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect())
    assert some.count() * 5 < all_pairs.count()
