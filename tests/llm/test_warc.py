import gzip
import hashlib
import glob

import pytest

from siftloom.llm.common import new_path
from siftloom.llm.warc import CHUNK_BYTES, read_chunks, records, write_archive


def test_round_trip_and_revisits(spark):
    long = "päge\r\n\r\nWARC/1.1\r\n" * 500
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, long, long, "\r\n", "\r\n\r\n", "end\r\n", "y" * 100, "z\x00\n" * 40]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 3 else None, h, 7) for i, h in enumerate(html)] + [(None, None, "y" * 100, 7), (4, None, "y" * 100, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    path = new_path(spark, "t")
    write_archive(df, path, "page_id", "html", "url", chunk_bytes=64)
    chunks = read_chunks(spark, path).cache()
    got = sorted(map(tuple, records(chunks).collect()), key=lambda r: (r[0] is None, r[0], r[1:3] and str(r[1:])))
    want = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        first = min(k for k, _, g, _ in rows if k is not None and (g or "").encode() == body)
        ref = first if len(body) >= 100 and i is not None and i > first else None
        want.append((i, "revisit" if ref is not None else "response", ref, len(body), hashlib.sha256(body).hexdigest()))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0], r[1:3] and str(r[1:])))
    assert max(r.n_bytes for r in chunks.collect()) <= 64
    own = b"".join(r.chunk for r in sorted(chunks.where("record_id = 6").collect(), key=lambda r: r.chunk_no))
    assert own == long.encode()
    raw = gzip.open(sorted(glob.glob(path.removeprefix("file:") + "/part-*"))[-1]).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")


def test_empty_table_and_broken_archive(spark):
    df = spark.createDataFrame([(1, "abc" * 50)], "page_id long, html string")
    a, b = new_path(spark, "t"), new_path(spark, "t")
    write_archive(df.limit(0), a, "page_id", "html")
    assert read_chunks(spark, a).count() == 0
    write_archive(df, b, "page_id", "html")
    file = glob.glob(b.removeprefix("file:") + "/part-*")[0]
    raw = gzip.open(file).read().replace(b"abcabc", b"abcabd", 1)
    with gzip.open(file, "wb") as f:
        f.write(raw)
    for crc in glob.glob(b.removeprefix("file:") + "/.*.crc"):
        __import__("os").remove(crc)
    with pytest.raises(Exception, match="differs from its digest"):
        read_chunks(spark, b).count()


def test_payloads_above_the_default_chunk(spark):
    """Long payloads are read back chunk by chunk, each with the digest of all bytes up to it."""
    body = "".join(f"{i:07d}é\n" for i in range(120_000))
    df = spark.createDataFrame([(1, body), (2, body), (3, body + "x"), (3, "short")], "page_id long, html string")
    path = new_path(spark, "t")
    write_archive(df, path, "page_id", "html")
    chunks = read_chunks(spark, path).collect()
    raw = body.encode()
    own = sorted((r for r in chunks if r.record_id == 1), key=lambda r: r.chunk_no)
    assert len(own) == -(-len(raw) // CHUNK_BYTES) > 3 and b"".join(r.chunk for r in own) == raw
    assert all(r.sha256 == hashlib.sha256(raw[: r.offset + r.n_bytes]).hexdigest() and r.n_bytes <= CHUNK_BYTES for r in own)
    got = sorted((r.record_id, r.record_type, r.payload_bytes) for r in records(read_chunks(spark, path, payload=False)).collect())
    assert got == [(1, "response", len(raw)), (2, "revisit", len(raw)), (3, "response", 5), (3, "response", len(raw) + 1)]
