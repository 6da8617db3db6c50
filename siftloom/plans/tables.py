"""Tables written to the shared folder, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a table of ids may be sent to all executors.
MOST_SENT = 200_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, a temporary folder of this machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftloom-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read again: no lineage, and no recomputation when an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more, such as those of former rounds."""
    for df in tables:
        if path := getattr(df, "_saved_at", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a table's files up to which it may be sent.
MOST_SENT_BYTES = 16 << 20


def sent_if_small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A saved table, marked for a broadcast if it has at most ``most`` rows and ``MOST_SENT_BYTES``."""
    fs = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    conf = df.sparkSession._jsc.hadoopConfiguration()
    size = sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in map(fs, df.inputFiles()))
    return F.broadcast(df) if size <= MOST_SENT_BYTES and df.count() <= most else df


def spread(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected ``edges`` reaches.

    Labels move along edges and then jump to their label's label, so the rounds are few.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    e = saved(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = saved(e.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "labels")
    while True:
        near = e.join(label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.alias("s").join(step.alias("t"), F.col("s.root") == F.col("t.node"), "left")
        new = saved(jump.select(F.col("s.node").alias("node"), F.least("s.root", F.coalesce("t.root", "s.root")).alias("root")), "labels")
        moved = new.join(label.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        forget(label)
        label = new
        if not moved:
            forget(e)
            return label


def numbered(df: DataFrame, *order: str, row: str = "row", bucket: str = "bucket") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0, and the number of the range of the order that it is in.

    Rows are dealt by ranges, so no task sorts them all: a range's rows are numbered from the number of
    rows before the range. Rows that are equal in ``order`` may land in any order within their range.
    """
    ranges = saved(df.repartitionByRange(*order).withColumn(bucket, F.spark_partition_id()), "ranges")
    before = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.groupBy(bucket).agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(W.partitionBy(bucket).orderBy(*order)) - 1
    return ranges.withColumn("__at", within).join(F.broadcast(starts), bucket).withColumn(row, F.col("__at") + F.col("__start")).select(*df.columns, row, bucket)


def running(events: DataFrame, key: str, order: str, bucket: str, n: str) -> DataFrame:
    """``events`` with ``before``: the sum of ``n`` over the events of ``key`` that come before, those of the smaller ``n`` first of equal ``order``.

    ``bucket`` is a range of the order (see ``numbered``). Sums are kept per key and range, so a key with
    many events is worked out in many tasks.
    """
    sums = events.groupBy(key, bucket).agg(F.sum(n).alias("__n"))
    prior = F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__prior", prior).drop("__n")
    own = F.coalesce(F.sum(n).over(W.partitionBy(key, bucket).orderBy(order, n).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("__own", own).join(sums, [key, bucket]).withColumn("before", F.col("__own") + F.col("__prior")).drop("__own", "__prior")
