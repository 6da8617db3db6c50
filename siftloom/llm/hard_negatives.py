"""Hard negatives by one-dimensional distance keys.

Inner products are turned into distances: each vector gets one more component, so that all have the
norm of the longest, while an anchor gets a zero; the larger the product, the nearer. The vectors
are stored sorted by (pivot, distance to it) and packed into blocks of neighbouring keys. By the
triangle inequality a block with keys [lo, hi] of a pivot at distance d from an anchor holds nothing
nearer than max(d - hi, lo - d): an anchor with radius r needs the key interval [d - r, d + r] of each
pivot. Radii grow by rounds, a round reads the blocks of the new annuli only, and an anchor is done
when what is left lies farther than its last result. The results are exact.

Pivots are fitted on at most ``SAMPLE`` rows; every row is indexed. Anchors travel in chunks, so that a
chunk meets a block in one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, in_arrow, written

#: Rows that pivots are fitted on (the smallest hashes), and the most pivots.
SAMPLE, MOST_PIVOTS = 4096, 256
#: Rows of a block, anchors of a chunk, blocks that a chunk meets in one task at most.
BLOCK, CHUNK, PART = 256, 256, 32
#: Beyond this squared norm products would not fit a long.
MOST_NORM = 2.0**62


class Space:
    """The pivots of each dimension, and distances in the space with one more component."""

    def __init__(self, norm: float, pivots: dict[int, np.ndarray]) -> None:
        self.norm, self.pivots, self.slack = norm, pivots, 1e-6 * np.sqrt(norm) + 1e-9

    def of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim + 1)))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.norm - (x * x).sum(1, keepdims=True), 0))])

    def to_pivots(self, lifted: np.ndarray, dim: int) -> np.ndarray:
        p = self.of(dim)
        return np.sqrt(np.maximum((lifted * lifted).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * lifted @ p.T, 0))

    def asked(self, x: np.ndarray, dim: int) -> np.ndarray:
        return self.to_pivots(np.hstack([x.astype(np.float64), np.zeros((len(x), 1))]), dim)

    def distance(self, own: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which rows of a score lie from anchors of the squared norm ``own``."""
        return np.sqrt(np.maximum(own + self.norm - 2.0 * score, 0))

    def exact(self, x: np.ndarray) -> np.ndarray:
        """In a type whose products are exact."""
        return x.astype(np.float64 if self.norm < 2**52 else np.int64)


def fitted(rows: DataFrame, norm: float) -> Space:
    """Pivots by k-means on a sample of at most ``SAMPLE`` rows, worked out in a task per dimension."""
    sample = rows.select("dim", "x", F.xxhash64("x", "vec_id").alias("h")).orderBy("h", "dim").limit(SAMPLE)
    n = dict(rows.groupBy("dim").count().join(sample.select("dim").distinct(), "dim").collect())

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        dim, space = int(g["dim"].iloc[0]), Space(norm, {})
        x = space.lifted(np.array([np.frombuffer(b, "<i4") for b in sorted(g["x"])]).reshape(len(g), dim))
        k = int(np.clip(round(np.sqrt(n[dim]) / 8), 1, min(MOST_PIVOTS, len(x))))
        p = x[np.random.default_rng(5).permutation(len(x))[:k]]
        for _ in range(8):
            nearest = Space(norm, {dim: p}).to_pivots(x, dim).argmin(1)
            p = np.array([x[nearest == j].mean(0) if (nearest == j).any() else p[j] for j in range(k)])
        return pd.DataFrame({"dim": dim, "p": [q.astype("<f8").tobytes() for q in p]})

    pivots: dict[int, list] = {}
    for dim, p in sample.groupBy("dim").applyInPandas(fit, "dim int, p binary").collect():
        pivots.setdefault(dim, []).append(np.frombuffer(p, "<f8"))
    return Space(norm, {d: np.array(p) for d, p in pivots.items()})


def _arrow(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[t]) for c, t in (f.split() for f in schema.split(", "))], names=[f.split()[0] for f in schema.split(", ")])


def _packed(rows: DataFrame, keys: list[str], most: int, schema: str, make) -> DataFrame:
    """Rows that follow each other with equal ``keys``, ``most`` at a time, as one row that ``make`` builds of their columns."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                cols = dict(zip(names, zip(*held, strict=True), strict=True))
                yield _arrow({k: [v] for k, v in make(cols).items()}, schema)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = tuple(r[names.index(c)] for c in keys)
                if k != at or len(held) == most:
                    yield from done()
                    at, held = k, []
                held.append(r)
        yield from done()

    return in_arrow(rows, run, schema)


def _bytes(x, kind: str) -> bytes:
    return np.asarray(x).astype(kind).tobytes()


KEYED = "dim int, pivot int, dist double, vec_id long, label long, h long, x binary"
BLOCKS = "dim int, pivot int, lo double, hi double, ids binary, hs binary, labels binary, x binary"


def keyed(rows: DataFrame, space: Space, asks: bool = False) -> DataFrame:
    """The rows with their nearest pivot and the distance to it; ``asks``: as anchors, without the added component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array(b.column(1).to_pylist())
            raw = b.column(4).to_pylist()
            pivot, dist = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array([np.frombuffer(raw[i], "<i4") for i in at]).reshape(len(at), dim)
                d = space.asked(x, int(dim)) if asks else space.to_pivots(space.lifted(x), int(dim))
                pivot[at], dist[at] = d.argmin(1), d.min(1)
            yield _arrow({"dim": dims, "pivot": pivot, "dist": dist, "vec_id": b.column(0), "label": b.column(2), "h": b.column(3), "x": raw}, KEYED)

    return in_arrow(rows.select("vec_id", "dim", "label", "h", "x"), run, KEYED)


def indexed(rows: DataFrame, space: Space) -> DataFrame:
    """The table of blocks: rows sorted by (pivot, distance), ``BLOCK`` of them a row, with the range of their keys."""
    order = ["dim", "pivot", "dist", "vec_id", "h"]
    rows = keyed(rows, space).repartitionByRange(*order).sortWithinPartitions(*order)
    make = lambda c: {
        "dim": c["dim"][0], "pivot": c["pivot"][0], "lo": c["dist"][0], "hi": c["dist"][-1], "ids": _bytes(c["vec_id"], "<i8"), "hs": _bytes(c["h"], "<i8"), "labels": _bytes(c["label"], "<i8"), "x": b"".join(c["x"]),
    }
    # an id of monotonically_increasing_id counts within its partition, so the quotient names at most PART blocks
    return written(_packed(rows, ["dim", "pivot"], BLOCK, BLOCKS, make).withColumn("block", F.monotonically_increasing_id()).withColumn("part", F.floor(F.col("block") / PART)), "blocks")


class Asks:
    """A chunk of anchors: vectors, labels, and for each the radii seen and wanted and the lists sought.

    A list of an anchor takes rows of ``scores`` from ``low`` to ``high``, the ``k`` best; ``floor`` is the k-th best so far.
    """

    FIELDS = {"ask": "<i8", "label": "<i8", "seen": "<f8", "wanted": "<f8", "near": "<f8"}
    LISTS = {"low": "<i8", "high": "<i8", "floor": "<i8"}
    SCHEMA = "dim int, x binary, " + ", ".join(f"{f} binary" for f in [*FIELDS, *LISTS])

    def __init__(self, r) -> None:
        self.dim = int(r["dim"])
        for f, t in self.FIELDS.items():
            setattr(self, f, np.frombuffer(r[f], t).copy())
        n = len(self.ask)
        for f, t in self.LISTS.items():
            setattr(self, f, np.frombuffer(r[f], t).reshape(n, -1).copy())
        self.x = np.frombuffer(r["x"], "<i4").reshape(n, self.dim)
        self.own = (self.x.astype(np.float64) ** 2).sum(1)

    def row(self) -> dict:
        return {"dim": self.dim, "x": _bytes(self.x, "<i4")} | {f: _bytes(getattr(self, f), t) for f, t in (self.FIELDS | self.LISTS).items()}


NONE = np.iinfo(np.int64).min
FOUND = "chunk long, ask long, list int, score long, id long, h long"


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The ``k`` first of each (ask, list): columns ask, list, score, id, h; higher scores first, then smaller ids."""
    order = np.lexsort((found[4], found[3], -found[2], found[1], found[0]))
    ask, lst = found[0][order], found[1][order]
    new = np.flatnonzero(np.concatenate([[True], (ask[1:] != ask[:-1]) | (lst[1:] != lst[:-1])]))
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return [c[order[rank < k]] for c in found]


def _scan(chunk: Asks, blocks: pd.DataFrame, space: Space, k: int, same: bool) -> list[np.ndarray]:
    """What the blocks of the new annuli hold for the chunk's lists (ask is the place in the chunk)."""
    n, lists = chunk.low.shape
    to, q, floor = space.asked(chunk.x, chunk.dim), space.exact(chunk.x), chunk.floor.copy()
    found = [np.zeros(0, np.int64) for _ in range(5)]
    for b in blocks.itertuples():
        d = to[:, b.pivot]
        least = np.maximum(np.maximum(d - b.hi, b.lo - d), 0)
        some = np.flatnonzero((least > chunk.seen) & (least <= chunk.wanted) & (d + b.hi >= chunk.near))
        if not len(some):
            continue
        ids, hs, labels = (np.frombuffer(x, "<i8") for x in (b.ids, b.hs, b.labels))
        x = np.frombuffer(b.x, "<i4").reshape(len(ids), chunk.dim)
        score = (q[some] @ space.exact(x).T).astype(np.int64)
        fits = (labels[None, :] == chunk.label[some][:, None]) == same
        parts = [found]
        for j in range(lists):
            low = np.maximum(chunk.low[some, j], floor[some, j])
            i, c = np.nonzero(fits & (score >= low[:, None]) & (score <= chunk.high[some, j][:, None]))
            parts.append([some[i], np.full(len(i), j), score[i, c], ids[c], hs[c]])
        found = _best([np.concatenate(c) for c in zip(*parts, strict=True)], k)
        at = np.flatnonzero(np.bincount(found[0] * lists + found[1], minlength=n * lists) == k)
        last = np.full(n * lists, np.iinfo(np.int64).max)
        np.minimum.at(last, found[0] * lists + found[1], found[2])
        floor.ravel()[at] = np.maximum(floor.ravel()[at], last[at])
    return found


def search(chunks: DataFrame, blocks: DataFrame, space: Space, k: int, same: bool, widen) -> DataFrame:
    """The ``k`` best rows of each list of the asks, of the asks' own label (``same``) or of other ones: (ask, list, score, id, h).

    ``chunks`` are rows of ``Asks.SCHEMA`` with a chunk id. After each round ``widen(asks, k-th scores)``
    gives the radius that each ask wants next; an ask whose radius does not grow is done.
    """
    spark = chunks.sparkSession
    index = written(blocks.select("dim", "pivot", "lo", "hi", "block", "part"), "index")
    state_schema = "chunk long, " + Asks.SCHEMA

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = Asks(r)
                on = a.wanted > a.seen
                d, w, near = space.asked(a.x[on], a.dim), a.wanted[on][:, None], a.near[on][:, None]
                if len(d):
                    yield _arrow({"chunk": [r["chunk"]] * d.shape[1], "dim": [a.dim] * d.shape[1], "pivot": range(d.shape[1]), "from": np.maximum(d - w, near - d).min(0), "to": (d + w).max(0)}, "chunk long, dim int, pivot int, from double, to double")

    def scan(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = Asks(left.iloc[0])
        ask, lst, score, ids, hs = _scan(a, right, space, k, same)
        return pd.DataFrame({"chunk": key[0], "ask": a.ask[ask], "list": lst, "score": score, "id": ids, "h": hs})

    def grow(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.to_dict("records"):
            a = Asks(r)
            place = {int(x): i for i, x in enumerate(a.ask)}
            for ask, lst, n, least in right[["ask", "list", "n", "least"]].itertuples(index=False):
                if n == k:
                    a.floor[place[ask], lst] = least
            a.seen, a.wanted = a.wanted, np.maximum(a.wanted, widen(space, a))
            if (a.wanted > a.seen).any():
                out.append({"chunk": r["chunk"]} | a.row())
        return pd.DataFrame(out, columns=[f.split()[0] for f in state_schema.split(", ")])

    state, found = chunks, spark.createDataFrame([], FOUND)
    while True:
        hull = in_arrow(state.select(*[f.split()[0] for f in state_schema.split(", ")]), reach, "chunk long, dim int, pivot int, from double, to double")
        pairs = written(hull.join(index, ["dim", "pivot"]).where("hi >= `from` and lo <= `to`").select("chunk", "part", "block"), "pairs")
        work = pairs.join(blocks.drop("part", "dim"), "block")
        heads = pairs.select("chunk", F.col("part").alias("at")).distinct().join(state, "chunk").withColumnRenamed("chunk", "head")
        new = heads.groupBy("head", "at").cogroup(work.groupBy("chunk", "part")).applyInPandas(scan, FOUND)
        place = F.row_number().over(Window.partitionBy("ask", "list").orderBy(F.desc("score"), "id", "h"))
        old, found = found, written(found.unionByName(new).withColumn("place", place).where(F.col("place") <= k).drop("place"), "found")
        ends = found.groupBy("chunk", "ask", "list").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        grown = written(state.groupBy("chunk").cogroup(ends.groupBy("chunk")).applyInPandas(grow, state_schema), "asks")
        for t in (pairs, old, state):
            forget(t)
        state = grown
        if not state.limit(1).count():
            return found


def _nearest(space: Space, a: Asks) -> np.ndarray:
    """Radius of the k-th result, or twice the radius so far, from a copy of the anchor on, as long as there is none; beyond all rows it stays."""
    all_rows = np.sqrt(a.own) + np.sqrt(space.norm) + space.slack
    copy = space.distance(a.own, a.own)
    more = np.maximum(copy + 2 * (a.wanted - copy), copy + np.sqrt(space.norm) / 32)
    end = np.where(a.floor[:, 0] > NONE, space.distance(a.own, a.floor[:, 0].astype(np.float64)) + space.slack, more)
    return np.minimum(end, all_rows)


def _window(space: Space, a: Asks) -> np.ndarray:
    """Radius of the k-th result of each list, or of the list's lowest score."""
    some = a.low <= a.high
    end = space.distance(a.own[:, None], np.maximum(a.low, a.floor).astype(np.float64)) + space.slack
    return np.where(some, end, -1).max(1, initial=-1)


def mine(vectors: DataFrame, key: str = "vec_id", label: str = "label", embedding: str = "embedding", anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, floor: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Rows with a null key, label or vector, or with a null or non-finite component, take no part. Components
    become floor(scale * x); a score is the inner product of two rows, and rows of different length have none.
    ``anchors`` is a condition on vec_id and label. An anchor's positives are its first ``positives`` other rows
    of the same label, the negatives of a pair the first ``negatives`` rows of other labels whose score s has
    floor * p <= 100 * s <= 100 * p with the positive's score p; higher scores come first, ties by key. Pairs
    without negatives have no row. Rows that repeat key, label and vector are one row; rows that repeat the key
    only are rows of their own (ties between them by a hash of the vector). Other columns are left out; an
    empty table gives an empty one. Vectors so long that products exceed a long are an error.

    Of equal vectors of one label only the ones of smallest keys are indexed, one more than results can need,
    and equal anchors are searched for once, so a group of copies costs no more than one of its rows.
    """
    spark, most = vectors.sparkSession, max(positives, negatives) + 1
    item = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), item.alias("v")).where("vec_id is not null and label is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    if norm >= MOST_NORM:
        raise ValueError("components are too large: inner products would not fit a long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in v], pa.int32()), pa.array([_bytes(x, "<i4") for x in v], pa.binary())], names=["vec_id", "label", "dim", "x"])

    rows = in_arrow(rows, pack, "vec_id long, label long, dim int, x binary").distinct()
    rows = written(rows.withColumn("h", F.xxhash64("x")), "rows")
    if not rows.where(anchors).limit(1).count():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    copies = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id"))
    kept = written(rows.withColumn("copy", copies).where(F.col("copy") <= most).drop("copy"), "kept")
    space = fitted(kept, float(norm))
    blocks = indexed(kept, space)

    chosen = rows.where(anchors)
    asks = written(chosen.groupBy("label", "dim", "x").agg(F.min("h").alias("h")).withColumn("vec_id", F.monotonically_increasing_id()), "asks")
    whose = written(chosen.join(asks.select("label", "x", F.col("vec_id").alias("ask")), ["label", "x"]).select("vec_id", "h", "ask"), "whose")
    order = ["dim", "pivot", "dist", "vec_id"]
    near = keyed(asks, space, asks=True).repartitionByRange(*order).sortWithinPartitions(*order)
    full = lambda n, x: np.full(n, x)

    def first(c: dict) -> dict:
        n = len(c["vec_id"])
        own = np.array([(np.frombuffer(x, "<i4").astype(np.float64) ** 2).sum() for x in c["x"]])
        start = space.distance(own, own) + np.sqrt(space.norm) / 32 + space.slack
        return {
            "dim": c["dim"][0], "x": b"".join(c["x"]), "ask": _bytes(c["vec_id"], "<i8"), "label": _bytes(c["label"], "<i8"), "seen": _bytes(full(n, -1.0), "<f8"), "wanted": _bytes(start, "<f8"),
            "near": _bytes(full(n, 0.0), "<f8"), "low": _bytes(full(n, NONE), "<i8"), "high": _bytes(full(n, np.iinfo(np.int64).max), "<i8"), "floor": _bytes(full(n, NONE), "<i8"),
        }

    chunks = _packed(near, ["dim"], CHUNK, Asks.SCHEMA, first)
    chunks = written(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    keep = written(chunks, "chunks")
    good = search(keep, blocks, space, positives + 1, True, _nearest)

    def windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The chunk with a list for each score of its positives, from high to low."""
        out = []
        for r in left.to_dict("records"):
            a = Asks(r)
            n, place = len(a.ask), {int(x): i for i, x in enumerate(a.ask)}
            a.low, a.high = np.full((n, positives + 1), 1), np.full((n, positives + 1), 0)
            a.floor = np.full((n, positives + 1), NONE)
            for ask, lst, score in right[["ask", "list", "score"]].itertuples(index=False):
                a.low[place[ask], lst], a.high[place[ask], lst] = -(-floor * int(score) // 100), score
            some = (a.low <= a.high).any(1)
            top = np.where(a.low <= a.high, a.high, NONE).max(1)
            a.near = np.maximum(space.distance(a.own, top.astype(np.float64)) - space.slack, 0)
            a.seen, a.wanted = np.full(n, -1.0), np.where(some, a.near + 2 * space.slack, -1.0)
            out.append({"chunk": r["chunk"]} | a.row())
        return pd.DataFrame(out, columns=["chunk", *[f.split()[0] for f in Asks.SCHEMA.split(", ")]])

    scores = good.select("chunk", "ask", "score").distinct()
    scores = written(scores.withColumn("list", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"))) - 1), "scores")
    wanted = written(chunks.groupBy("chunk").cogroup(scores.groupBy("chunk")).applyInPandas(windows, "chunk long, " + Asks.SCHEMA), "windows")
    bad = search(wanted, blocks, space, negatives, False, _window)

    pairs = whose.join(good.select("ask", F.col("id").alias("positive_id"), F.col("h").alias("other"), F.col("score").alias("positive_score")), "ask").where("positive_id <> vec_id or other <> h")
    place = F.row_number().over(Window.partitionBy("vec_id", "h", "ask").orderBy(F.desc("positive_score"), "positive_id", "other"))
    pairs = pairs.withColumn("place", place).where(F.col("place") <= positives)
    rank = F.row_number().over(Window.partitionBy("ask", "list").orderBy(F.desc("score"), "id", "h"))
    lists = bad.withColumn("rank", rank).join(scores.select("ask", "list", F.col("score").alias("positive_score")), ["ask", "list"])
    lists = lists.select("ask", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(lists, ["ask", "positive_score"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
