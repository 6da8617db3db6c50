"""Embedding near-dedup by spherical-cap filters.

A filter is a direction in space; it holds the vectors whose inner product with it exceeds a
threshold. Directions come from a structured code: the rotated space is cut into two blocks
with a random codebook each, and every pair of codewords is a direction (more blocks make the
lists of some vectors much longer than others'). The pairs above
the threshold are list-decoded from the blocks' products, sorted and cut off by bounds, so the
cost follows the length of the list and not the number of directions. Near vectors share a
filter with high probability; vectors are joined on filters and every pair is verified in
double precision, in blocks of bounded size, in the first filter that both share.

The codebook grows with the number of vectors, so filters hold about as many vectors at every
size. The threshold is set on random pairs at exactly the wanted cosine, so that a share
``RECALL`` of such pairs meets; nearer pairs meet more surely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_arrow, sent_if_small, written

RECALL = 0.99
#: Vectors that a filter holds on average, about; members of a filter that meet in one block.
PER_FILTER = 64
BLOCK = 1024
BLOCKS = 2


@dataclass
class CapFilters:
    """The code for one dimension: a rotation, a codebook a block, the threshold."""

    rotation: np.ndarray
    books: list[np.ndarray]
    threshold: float = 0.0

    @classmethod
    def drawn(cls, dim: int, words: int, threshold: float = 0.0, seed: int = 11) -> CapFilters:
        """The same code wherever it is drawn."""
        rng = np.random.default_rng(seed)
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        cuts = np.array_split(np.arange(dim), BLOCKS)
        books = [rng.normal(size=(words, len(c))) for c in cuts]
        books = [b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12) / np.sqrt(BLOCKS) for b in books]
        return cls(rotation, books, threshold)

    @classmethod
    def made(cls, dim: int, words: int, cosine: float, recall: float = RECALL, seed: int = 11) -> CapFilters:
        self, rng = cls.drawn(dim, words, seed=seed), np.random.default_rng(seed + 1)
        x, z = rng.normal(size=(2, 400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = cosine * x + np.sqrt(1 - cosine**2) * z
        low, high = 0.0, 1.0
        for _ in range(12):
            self.threshold = (low + high) / 2
            met = np.mean([bool(np.intersect1d(self.decode(a), self.decode(b)).size) for a, b in zip(x, y, strict=True)])
            low, high = (self.threshold, high) if met >= recall else (low, self.threshold)
        self.threshold = low
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """All filters that the unit vector ``x`` exceeds, in increasing order; its nearest one if none."""
        r, at, order, p = self.rotation @ x, 0, [], []
        for book in self.books:
            s = book @ r[at : at + book.shape[1]]
            at += book.shape[1]
            order.append(np.argsort(-s))
            p.append(s[order[-1]])
        words, t = len(p[0]), self.threshold
        # products fall along each block, so what can still reach the threshold is a prefix
        n = int(np.searchsorted(-p[0], p[1][0] - t, side="right"))
        k = np.searchsorted(-p[1], p[0][:n] - t, side="right")
        which = np.repeat(np.arange(n), k)
        if not len(which):
            return np.array([order[0][0] * words + order[1][0]], dtype=np.int64)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
        return np.sort(order[0][which] * words + order[1][rank]).astype(np.int64)


@lru_cache(maxsize=2)
def _code(dim: int, words: int, threshold: float) -> CapFilters:
    """Drawn in each worker, so that nothing that grows with the table is sent."""
    return CapFilters.drawn(dim, words, threshold)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is brought near 1 by a power of two first, so that no square under- or overflows."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(rows: list[tuple], cosine: float, kind: str, small: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(classes, ids, weighted links, label) of one filter's cell; rows are (filter, i, j, part, id, n, vector, filters, class)."""
    if len(rows) < 2:
        return
    here, i, j = rows[0][:3]
    left = np.array([r[3] == i for r in rows])
    ids, n = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    x = _unit(np.array([np.frombuffer(r[6], kind) for r in rows]))
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if i != j:
        near &= left[:, None] != left[None, :]
    if not near.any():
        return
    # a pair counts in the first filter that it shares
    lists = [f[: np.searchsorted(f, here)] for f in (np.frombuffer(r[7], "<i4" if small else "<i8") for r in rows)]
    which, column = np.unique(np.concatenate(lists), return_inverse=True)
    if len(which):
        row = np.repeat(np.arange(len(rows)), [len(f) for f in lists])
        for at in range(0, len(which), 4096):
            own = (column >= at) & (column < at + 4096)
            m = np.zeros((len(rows), min(4096, len(which) - at)), np.float32)
            m[row[own], column[own] - at] = 1
            m = m[:, m.sum(0) > 1]
            near &= ~((m @ m.T) > 0)
    links = near @ n
    some = np.flatnonzero(links)
    if not len(some):
        return
    near, ids, links = near[np.ix_(some, some)], ids[some], links[some]
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            break
        label = new
    yield np.array([rows[k][8] for k in some]), ids, links, label


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", embedding: str = "embedding", per_filter: int = PER_FILTER, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: the number of other vectors found at ``cosine``
    or nearer, and the smallest id reachable by such links.

    Equal vectors are merged first and counted with their number. Null vectors, zero vectors and
    vectors with null or non-finite components link with nothing, nor do vectors of different
    dimension or rows with a null id (whose component_id and kept are null). Rows that repeat an
    id are one node of the components. Very short and very long vectors keep their direction. Other columns are left out; an empty table gives an empty one.
    """
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind, item = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{item}>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))
    rows = rows.select("vec_id", F.when(fine, F.transform("v", lambda x: (x + F.lit(0.0)).cast(item))).alias("v")).withColumn("dim", F.size("v"))
    digest = F.when(F.col("v").isNotNull(), F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    rows = written(rows.withColumn("digest", digest), "vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")).withColumn("class", F.monotonically_increasing_id()), "classes")

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(d, w, CapFilters.made(d, w, cosine).threshold) for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in [max(8, round((24 * n / per_filter) ** (1 / BLOCKS)))]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["dim", "words", "threshold"])

    codes = written(in_arrow(classes.groupBy("dim").agg(F.count("*").alias("n")), calibrated, "dim int, words long, threshold double"), "codes")
    small = (codes.agg(F.max("words")).first()[0] or 0) ** BLOCKS < 1 << 31

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, dim, v, own, words, least = (b.column(k) for k in range(7))
            x = [np.array(t, dtype=np.float64) for t in v.to_pylist()]
            lists = [_code(*c).decode(_unit(t[None, :])[0]) for *c, t in zip(dim.to_pylist(), words.to_pylist(), least.to_pylist(), x, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, n, dim, pa.array([t.astype(kind).tobytes() for t in x], pa.binary()), pa.array([f.astype("<i4" if small else "<i8").tobytes() for f in lists], pa.binary()), pa.array([f.tolist() for f in lists], pa.list_(pa.int64())), own], names=["id", "n", "dim", "x", "list", "filters", "class"])

    listed = written(in_arrow(classes.join(sent_if_small(codes), "dim").select("id", "n", "dim", "v", "class", "words", "threshold"), decode, "id long, n long, dim int, x binary, list binary, filters array<long>, class long"), "lists")
    each = listed.select("dim", F.explode("filters").alias("filter"), "id", "n", "x", "list", "class")
    sizes = each.groupBy("dim", "filter").agg(F.count("*").alias("size")).where("size > 1")
    sizes = written(sizes.withColumn("parts", F.ceil(F.col("size") / block).cast("int")).drop("size"), "sizes")
    each = each.join(sizes, ["dim", "filter"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = each.select("dim", "filter", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "n", "x", "list", "class")
    cells = cells.repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def done() -> list[pa.RecordBatch]:
            return [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["class", "id", "links", "label"]) for out in _blocks(rows, cosine, kind, small)]

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for r in zip(*cols, strict=True):
                if r[:4] != cell:
                    yield from done()
                    cell, rows = r[:4], []
                rows.append(r[1:])
        yield from done()

    met = written(in_arrow(cells, meet, "class long, id long, links long, label long"), "met")
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    classes = written(classes.select("class", "digest", "id", "n").join(links, "class", "left"), "classes")
    placed = written(rows.join(classes, "digest", "left").select("vec_id", "id", (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "placed")
    edges = met.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(placed.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    root = components(edges)
    out = placed.join(root.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
