r"""WARC archives written and read as chunk rows.

A payload is never one row of the archive: it is cut into (record id, chunk number) rows of
at most ``CHUNK_BYTES``. Each row is one WARC/1.1 record; a record's first chunk is a response
whose further chunks follow as continuation records (WARC segmentation). Rows of one payload
stay together and in order, so a reader holds one chunk and one running SHA-256 at a time.

Files are made by Spark's own text writer with the record end (CR LF CR LF) as separator, so
any store that Spark writes works and a lost executor only costs its tasks. They are
gzip-compressed, hence each is read by one task from its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow

CHUNK_BYTES = 256 * 1024
END = "\r\n\r\n"


def plan_revisits(digests: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(key, digest, refers_to): the rows that repeat a payload of a smaller key.

    ``digests`` has key, digest, n_bytes. Payloads below ``least_bytes`` and null keys are
    left out. Rows that repeat a key and payload in full are all first ones.
    """
    big = digests.where((F.col("n_bytes") >= least_bytes) & F.col("key").isNotNull())
    first = big.groupBy("digest").agg(F.min("key").alias("refers_to"), F.max("key").alias("last")).where("last > refers_to").drop("last")
    return big.join(first, "digest").where("key > refers_to").select("key", "digest", "refers_to").distinct()


def write_archive(pages: DataFrame, path: str, key: str, payload: str, url: str | None = None, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 100, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record per row of ``pages`` to the folder ``path``.

    A null payload is written as an empty one, a null key as an empty id, a null URL without
    target URI; an empty table gives an archive without records. Rows that repeat a key are a record each. Records of equal payloads of
    ``least_bytes`` or more refer to the one of the smallest key as revisits without payload.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("body"), (F.col(url) if url else F.lit(None)).cast("string").alias("uri"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("n", F.octet_length("body"))
    revisits = plan_revisits(rows.select("key", "digest", F.col("n").alias("n_bytes")), least_bytes)
    rows = rows.join(revisits, ["key", "digest"], "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    opt = lambda cond, x: F.when(cond, x).otherwise(F.lit(""))
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    n_chunks = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_bytes))).cast("int")
    # numbers are exploded and each row cuts its own chunk, so a payload's chunks are never held together
    seg = rows.select("key", "uri", "digest", "n", "refers_to", "body", n_chunks.alias("of"), F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("i"))
    chunk = F.when(revisit, F.lit("").cast("binary")).otherwise(F.substring(F.col("body"), F.col("i") * chunk_bytes + 1, F.lit(chunk_bytes)))
    seg = seg.select("key", "uri", "digest", "n", "refers_to", "of", "i", chunk.alias("chunk"))
    first, last = F.col("i") == 0, F.col("i") == F.col("of") - 1
    http = opt(first & F.col("refers_to").isNull(), F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END)))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, rid(F.col("key"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("i").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        opt(F.col("uri").isNotNull(), line("WARC-Target-URI", F.regexp_replace("uri", r"[\r\n]", "%20"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("X-Chunk-Digest", F.concat(F.lit("sha256:"), F.sha2("chunk", 256))),
        opt(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", rid(F.col("refers_to"))))),
        opt(F.col("of") > 1, line("WARC-Segment-Number", (F.col("i") + 1).cast("string"))),
        opt(~first, line("WARC-Segment-Origin-ID", rid(F.col("key")))),
        opt(last & (F.col("of") > 1), line("WARC-Segment-Total-Length", F.col("n").cast("string"))),
        opt(first, line("Content-Type", F.lit("application/http; msgtype=response"))),
        F.lit("Content-Length: "),
        (F.octet_length(http) + F.octet_length("chunk")).cast("string"),
        F.lit(END),
    )
    record = F.concat(head.cast("binary"), http.cast("binary"), F.col("chunk")).cast("string")
    seg.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Stream:
    """Cuts the bytes of one archive, fed piece by piece, into (headers, block)."""

    def __init__(self) -> None:
        self.buf, self.head, self.need = bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict, bytes]]:
        self.buf += piece
        while True:
            if self.head is None:
                if self.buf == b"\r\n\r\n":  # the file ended within a separator, as after a block's own line ends
                    self.buf.clear()
                at = self.buf.find(b"\r\n\r\n")
                if at < 0:
                    return
                lines = bytes(self.buf[:at]).decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record where one should start: {lines[0][:40]!r}")
                self.head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
                self.need = int(self.head["Content-Length"])
                del self.buf[: at + 4]
            if len(self.buf) < self.need + 4:
                return
            block, head = bytes(self.buf[: self.need]), self.head
            del self.buf[: self.need + 4]
            self.head = None
            yield head, block

    def end(self) -> None:
        if self.head is not None or self.buf:
            raise ValueError("the archive ends within a record")


CHUNKS = "record_id long, record_type string, refers_to long, chunk_no int, offset long, n_bytes long, sha256 string, last boolean, payload_digest string, payload_bytes long, chunk binary"


def read_chunks(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archive's chunk rows; ``sha256`` is the digest of the payload up to and with the chunk.

    ``last`` marks a record's last chunk; a revisit is one row without bytes. With
    ``payload=False`` chunk is null. payload_digest and payload_bytes are what the headers state.
    A broken archive, or a chunk or payload that differs from its stated digest, raises an error; a
    bad chunk does so before the rest of its payload is read. Records that repeat an id are read one
    after the other, each with its own chunk rows from 0 on; a record without id has a null one.
    """
    if not _has_rows(spark, path):
        return spark.createDataFrame([], CHUNKS)
    text = spark.read.option("lineSep", END).schema("value string").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def ident(x: str | None) -> int | None:
        x = (x or "").strip("<>").removeprefix("urn:page:").split(":")[0]
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream, sha, offset, no = None, _Stream(), hashlib.sha256(), 0, 0
        for b in batches:
            out = []
            for f, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if f != file:
                    stream.end()
                    file, stream = f, _Stream()
                for head, block in stream.feed(piece + b"\r\n\r\n"):
                    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    total = int(head["X-Payload-Length"])
                    if kind == "revisit":
                        out.append((ident(head["WARC-Record-ID"]), kind, ident(head["WARC-Refers-To"]), 0, 0, 0, stated, True, stated, total, None))
                        continue
                    if kind == "response":
                        sha, offset, no = hashlib.sha256(), 0, 0
                        block = block[block.index(b"\r\n\r\n") + 4 :]
                        record = ident(head["WARC-Record-ID"])
                    else:
                        record = ident(head["WARC-Segment-Origin-ID"])
                    if hashlib.sha256(block).hexdigest() != head["X-Chunk-Digest"].removeprefix("sha256:"):
                        raise ValueError(f"chunk {no} of record {record} differs from its digest")
                    sha.update(block)
                    last = offset + len(block) == total
                    if last and sha.hexdigest() != stated:
                        raise ValueError(f"the payload of record {record} differs from its digest")
                    out.append((record, "response", None, no, offset, len(block), sha.hexdigest(), last, stated, total, block if payload else None))
                    offset, no = offset + len(block), no + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 11, TYPES, strict=True)], names=NAMES)
        stream.end()

    return in_arrow(rows, run, CHUNKS)


NAMES = [x.split()[0] for x in CHUNKS.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in CHUNKS.split(", ")]


def _has_rows(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return any(x.getPath().getName().startswith("part-") for x in fs.listStatus(p))


def records(chunks: DataFrame) -> DataFrame:
    """A row per record: record_id, record_type, refers_to, payload_bytes, payload_digest.

    A response's figures are those of the bytes read (its last chunk's running digest). Records that
    repeat an id have a row each.
    """
    return chunks.where("last").select("record_id", "record_type", "refers_to", F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.col("offset") + F.col("n_bytes")).alias("payload_bytes"), F.col("sha256").alias("payload_digest"))
