"""What several corpus operators share: shared folders, written tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks that separate words: space, tab, LF, VT, FF, CR.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir``. Only where that is unset (as in tests on one
    machine) a temporary folder is made and set for the session.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    This cuts the lineage: a lost executor costs a reread of files and no recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftloom_path = path
    if (own := _SCRATCH.get()) is not None:
        own.append(out)
    return out


#: Tables written within the innermost ``scratch``.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables ``written`` within it, but those passed through the function that it gives.

    What is kept belongs to the scratch around it, if there is one.
    """
    own, kept, outer = [], [], _SCRATCH.get()
    token = _SCRATCH.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for df in own:
            if not any(df is k for k in kept):
                forget(df)
        if outer is not None:
            outer.extend(kept)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    path = getattr(df, "_siftloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Rows, and bytes of its files, up to which a written table may be sent to all executors.
MOST_SENT = 1_000_000
MOST_SENT_BYTES = 16 << 20


def _bytes(df: DataFrame) -> int | None:
    """Bytes of the files of a ``written`` table."""
    path = getattr(df, "_siftloom_path", None)
    if path is None:
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).getContentSummary(p).getLength()


def sent_if_small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df``, a ``written`` table, marked for a broadcast if it has at most ``most`` rows and ``MOST_SENT_BYTES``.

    A larger one is joined by a shuffle.
    """
    size = _bytes(df)
    if size is None:
        raise ValueError("only a written table has a known size")
    return F.broadcast(df) if size <= MOST_SENT_BYTES and df.count() <= most else df


#: Ids that are sent at once where rows are picked, and times that the rows are read for that.
MOST_SENT_IDS = 1_000_000
MOST_SLICES = 4


def picked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``ids``, a ``written`` table without repeats.

    The ids are sent in slices, and the rows, which may hold whole texts, are read once a slice and not
    shuffled. Only ids of more than ``MOST_SLICES`` slices are joined by a shuffle.
    """
    n = max(1, -(-ids.count() // MOST_SENT_IDS))
    if n > MOST_SLICES:
        return rows.join(ids, key, "left_semi")
    slices = [ids.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [ids]
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(s), key, "left_semi") for s in slices])


#: Keys of each side that ``once`` looks at.
FEW = 4


def few_of(keys: Column) -> Column:
    """The smallest of the array ``keys``, for ``once``."""
    return F.slice(F.sort_array(keys), 1, FEW)


def once(key: str, few_a: str, few_b: str) -> Column:
    """False where a pair that meets under ``key`` also meets under a smaller key that is among the few of both sides.

    So a pair that shares many keys is made a few times, and always under the smallest one that it shares.
    """
    return F.coalesce(F.array_min(F.array_intersect(few_a, few_b)) >= F.col(key), F.lit(True))


#: Rows that Python code works on at once; texts may be long.
BATCH_ROWS = 256


#: A copy of each session that has used ``in_arrow``, by the session's name.
_COPIES: dict = {}


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with small batches, so that a few of them fit any worker's memory.

    The size of batches is a setting of sessions. The result is therefore bound to a copy of the
    session, which takes over all other settings of now; the caller's session stays as it is. There
    is one copy a session, since each session has Python workers of its own.
    """
    spark = df.sparkSession
    own = spark._jsparkSession
    copy = _COPIES.get(own.sessionUUID())
    if copy is None:
        copy = _COPIES[own.sessionUUID()] = own.cloneSession()
    copy.sessionState().conf().settings().putAll(own.sessionState().conf().settings())
    copy.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    bound = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, df._jdf.logicalPlan())
    return DataFrame(bound, spark).mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, root), root the smallest node.

    Only nodes that have an edge to another node appear. Rounds alternate between linking
    each node's larger neighbours and its smaller neighbours to the smallest one, until
    every component is a star; the number of rounds is logarithmic in practice. Every round
    is two aggregations and two joins on plain keys, so a hub is split like any skewed join
    key and nothing is gathered in one task or on the driver but two checksums a round.
    Null ends and self loops are ignored, repeated edges count once, no edge gives no row.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    cur = written(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(hi.alias("u"), lo.alias("v")).distinct(),
        "cc",
    )
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt = written(small, "cc")
        forget(cur)
        cur = nxt
        row = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(row)
