"""Quality classifier: a factorisation machine on hashed words, structure and metadata.

score = sigmoid(w0 + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), so the
pairwise part costs one pass over a text's features. The model is fitted on the driver on a
bounded sample of labelled rows; scoring is one Arrow scan over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Most labelled rows that a fit reads; those of the smallest hash of their id.
MOST_ROWS = 4000
WORD_BITS = 13
RANK = 6
EPOCHS = 5

#: Structure figures and metadata; see ``features``.
DENSE = 14

_FEED = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"), re.compile(rb"[#*$%&|<>]"), re.compile(rb"[.,;:!?]")


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): DENSE structure figures and metadata, then hashed distinct words.

    Words are split at blanks, lower-cased and hashed by CRC-32; their values are the square
    roots of their counts, summed where hashes agree, scaled to length 1. A null text counts as empty, a null n_chars as
    the text's own length.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, size = len(words), len(raw)
    upper, digits, symbols, points = (sum(map(len, p.findall(raw))) for p in _FEED)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    short = sum(len(x.split(None, 3)) < 3 for x in lines)
    kept = max(1, sum(map(len, words)))
    dense = np.array([
        1.0,
        np.log1p(n) / 8,
        np.log1p(len(raw) if n_chars is None else max(0, n_chars)) / 10,
        min(kept / max(1, n), 20) / 10,
        upper / kept,
        digits / kept,
        min(1.0, 3 * symbols / kept),
        min(1.0, 3 * points / kept),
        len(counts) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        short / max(1, len(lines)),
        np.log1p(size / max(1, len(lines))) / 8,
        float(n < 20),
        max(counts.values(), default=0) / max(1, n),
    ])
    if not n:
        return np.arange(DENSE), dense
    index = np.fromiter(map(zlib.crc32, counts), dtype=np.int64, count=len(counts)) & ((1 << WORD_BITS) - 1)
    value = np.bincount(index, np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts))), 1 << WORD_BITS)
    index = np.flatnonzero(value)
    value = value[index]
    return np.concatenate([np.arange(DENSE), DENSE + index]), np.concatenate([dense, value / np.sqrt((value**2).sum())])


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, i: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[i] * x[:, None]
        return self.w0 + self.w[i] @ x + 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum())

    def score(self, text: str | None, n_chars: int | None) -> float:
        z = self.logit(*features(text, n_chars))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def fit(rows: list[tuple[str | None, int | None, int]], **settings) -> Machine:
    """``fit_features`` over ``rows`` of (text, n_chars, label)."""
    return fit_features([(*features(t, c), y) for t, c, y in rows], **settings)


def fit_features(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.1, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over ``rows`` of (indices, values, label).

    Without rows, or rows of one label, the weights stay at the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    size = DENSE + (1 << WORD_BITS)
    good = sum(y for *_, y in rows)
    m = Machine(float(np.log((good + 1) / (len(rows) - good + 1))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    if not 0 < good < len(rows):
        m.v[:] = 0
        return m
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            vi = m.v[i]
            vx = vi * x[:, None]
            s = vx.sum(0)
            z = m.w0 + m.w[i] @ x + 0.5 * float((s**2 - (vx**2).sum(0)).sum())
            d = 1 / (1 + np.exp(-max(-30.0, min(30.0, z)))) - y
            g0 += d * d
            m.w0 -= rate * d / np.sqrt(g0)
            gr = d * x
            np.add.at(gw, i, gr**2)
            np.add.at(m.w, i, -rate * gr / np.sqrt(gw[i]))
            gr = d * (x[:, None] * s - vi * (x**2)[:, None]) + 1e-4 * vi
            np.add.at(gv, i, gr**2)
            np.add.at(m.v, i, -rate * gr / np.sqrt(gv[i]))
    return m


def held_out(key: str) -> Column:
    """Rows whose crc32 of the id as text is a multiple of 5 are kept from the fit."""
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % 5 == 0


def _with_n_chars(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", most_rows: int = MOST_ROWS, text: str = "text") -> Machine:
    """Fit on at most ``most_rows`` labelled documents that are not held out.

    Rows without id or label do not count; of several labels of one id the largest holds, of
    several texts the largest. The sample is that of the smallest id hashes, so it is the same
    on every run and its size does not depend on the corpus. Executors make the features, at most
    DENSE + 2^WORD_BITS a row, and only those come to the driver. n_chars is optional.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("__k")).agg(F.max("quality").alias("__y"))
        .orderBy(F.xxhash64("__k"), "__k").limit(most_rows)
    )
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("text"), _with_n_chars(docs).alias("n_chars")).join(F.broadcast(chosen), "__k").groupBy("__k", "__y").agg(F.max(F.struct("text", "n_chars")).alias("__d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t, c) for t, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([x.astype("<f8").tobytes() for _, x in made], pa.binary())], names=["k", "y", "i", "x"])

    rows = in_arrow(rows.select(F.xxhash64("__k").alias("k"), (F.col("__y") > 0).cast("int").alias("y"), "__d.text", "__d.n_chars"), run, "k long, y int, i binary, x binary").collect()
    return fit_features([(np.frombuffer(r.i, "<i4"), np.frombuffer(r.x, "<f8"), r.y) for r in sorted(rows, key=lambda r: r.k)])


def score(docs: DataFrame, machine: Machine, least: float = 0.3, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` plus the columns ``into``: score (0 to 1) and predicted (1 from ``least`` on).

    Only the text and n_chars, which is optional, are read for a score. Null and empty texts are
    scored by their structure figures; repeated rows alike; an empty table gives an empty one.
    Columns that are named as in ``into`` are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in into]
    sent = spark.sparkContext.broadcast(machine)  # of a size fixed by WORD_BITS and RANK
    df = docs.select(F.col(text).alias("__text"), _with_n_chars(docs).alias("__n"), *keep)
    kept = {f.name: f for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kept[c].dataType.simpleString()}" for c in keep), f"`{into[0]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = [m.score(t, n) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.float64())], names=[*keep, into[0]])

    return in_arrow(df, run, schema).withColumn(into[1], (F.col(into[0]) >= least).cast("int"))
