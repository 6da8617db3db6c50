"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is a blob named by the SHA-256 of its text. The ledger keeps,
per blob and version of the rules, what was found. A scan reads only the blobs for which the
ledger has no entry of the present rules, adds them, and joins the findings to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, new_path, sent_if_small, written

#: kind -> (pattern, group whose length counts, least length). Fixed values; the first three are
#: the base kinds. A run of hexadecimal digits is maximal, so {32,} finds what + and a length test would.
#: A private key goes to its end line or, where that is missing, as far as its coded lines go.
KINDS = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "pem": (r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*-----END (?:[A-Z]+ )?PRIVATE KEY-----|(?:\s*[A-Za-z0-9+/=]{16,}(?!\S))*)", 0, 1),
    "grant": (r"(?a)\b(?:ghp|gho|ghs|xoxb|xoxp)[_-][A-Za-z0-9-]{20,}", 0, 24),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = "2"

FOUND = "array<struct<kind:string,start:int,end:int>>"


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def blob_name(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class BlobLedger:
    """A folder of (blob_id, rule_version, found) rows; appended to, never rewritten."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def entries(self) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"blob_id binary, rule_version string, found {FOUND}"
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def scan(self, versions: DataFrame, path: str = "path", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
        """(path, blob_id, found) per row of ``versions``; ``found`` lists spans, empty if none.

        A null text counts as empty. Of the rows that share a blob, one is scanned, and none where the
        ledger has the blob under this rule version; all get the findings by a join on the blob, in
        which only blobs with findings take part. Null paths are scanned and kept, repeated rows stay.
        An empty table gives an empty one. Other columns are left out.
        """
        rows = versions.select(F.col(path).alias("path"), blob_name(F.col(text)).alias("blob_id"))
        rows = written(rows, "versions")
        known = self.entries().where(F.col("rule_version") == rule_version).select("blob_id").distinct().withColumn("known", F.lit(True))
        own = rows.groupBy("blob_id", "path").agg(F.count("*").alias("times")).groupBy("blob_id").agg(F.count("*").alias("paths"), F.min(F.struct("path", "times")).alias("first"))
        # blobs of one row that the ledger lacks, which most are, need no mark
        marks = own.join(known, "blob_id", "left").where("known or paths > 1 or first.times > 1")
        marks = written(marks.select("blob_id", "first.path", "first.times", F.coalesce("known", F.lit(False)).alias("known")), "marks")
        texts = versions.select(F.col(path).alias("path"), F.col(text).alias("text"), blob_name(F.col(text)).alias("blob_id"))
        texts = texts.join(sent_if_small(marks).withColumnRenamed("path", "first"), "blob_id", "left").where("known is null or not known")
        todo = texts.where(F.col("known").isNull() | (F.col("path").eqNullSafe(F.col("first")) & (F.col("times") == 1)))
        self._add(todo, rule_version)
        if marks.where("not known and times > 1").limit(1).count():  # the same version of the same path, several times
            self._add(texts.where(F.col("path").eqNullSafe(F.col("first")) & (F.col("times") > 1)).dropDuplicates(["blob_id"]), rule_version)
        found = self.entries().where((F.col("rule_version") == rule_version) & (F.size("found") > 0)).select("blob_id", "found").dropDuplicates(["blob_id"])
        return rows.join(found, "blob_id", "left").select("path", "blob_id", F.coalesce("found", F.array().cast(FOUND)).alias("found"))

    def _add(self, todo: DataFrame, rule_version: str) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for b in batches:
                spans = [[dict(kind=k, start=s, end=e) for k, s, e in find_spans(t)] if t else [] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["blob_id", "found"])

        out = in_arrow(todo.select("blob_id", "text"), run, f"blob_id binary, found {FOUND}")
        out.select("blob_id", F.lit(rule_version).alias("rule_version"), "found").write.mode("append").parquet(self.path)


def replaced(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with each of the spans, in order of their starts, replaced by ``mark``; overlapping ones merge."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _replaced(mark: str):
    @F.arrow_udf("string")
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([None if t is None else replaced(t, sorted((x["start"], x["end"]) for x in f), mark) for t, f in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    return run


def redact(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every found span of its text replaced by ``mark``; overlapping spans merge.

    ``found`` is what ``scan`` gives for these rows. A column n_chars follows the new text.
    Rows without findings, null texts and other columns stay as they are.
    """
    hits = found.where(F.size("found") > 0).select(F.col("path").alias("__k"), F.col("blob_id").alias("__b"), "found").dropDuplicates(["__k", "__b"])
    hits = sent_if_small(written(hits, "hits"))
    rows = docs.select(docs[key].alias("__key"), blob_name(docs[text]).alias("__blob"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    rows = rows.join(hits, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__blob") == F.col("__b")), "left")
    t = F.col(f"__row.{text}")
    some = F.col("found").isNotNull()
    rows = rows.withColumn("__new", F.when(some, _replaced(mark)(F.when(some, t), F.when(some, F.col("found")))).otherwise(t))
    cols = [F.col("__new").alias(c) if c == text else F.coalesce(F.length("__new").cast("long"), F.col("__row.n_chars")).alias(c) if c == "n_chars" else F.col(f"__row.{c}").alias(c) for c in docs.columns]
    return rows.select(*cols)
