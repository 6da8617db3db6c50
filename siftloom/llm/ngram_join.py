"""N-gram Jaccard join by parity sketches; exact.

A text's set of word shingles is hashed token by token into a bit sketch in which every token
flips one bit. Sketches of two sets differ in at most as many bits as the sets differ in
tokens, and sets of Jaccard similarity >= num/den whose smaller one has a tokens differ in at
most D = (den - num) * a / num of them. So sketches are cut into B = D + 1 + slack blocks of
which similar sets share at least 1 + slack; joining on blocks, per band of set sizes, misses
no pair. The blocks are so wide that few bits are set; a block is kept as a 64-bit hash of its
set bits. Blocks without a set bit say nothing, and those of one token, which may be frequent,
say little. They are left out: a set with no more than ``slack`` of them still shares another
block with every similar set, for a shared block has the same tokens in both; the other sets
keep those of one token, and all where too many are empty.

Work on pairs stays linear in the number of shared blocks:
* equal sets of one batch are merged before anything is sent, and a block that one batch holds
  several times is sent once, so a block that a third of all texts share costs a row per batch;
* of a shared block, each member is compared with the smallest id only (a star);
* then only members of different components that share a block are compared with each other.
  Blocks with more than ``HOT`` members take part there only between sets that have so many
  hot blocks that the slack doesn't cover them; all others share a further block. A pair that shares
  many blocks is made under the smallest one that it shares and few others (``once``).
Candidates pass exact bounds on set sizes and on a folded 512-bit sketch, then the shingles of
both whole texts are compared.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import components, few_of, in_arrow, once, picked, scratch, shuffle_partitions, written

#: Members from which on a block is hot, and keys that a batch gathers before it is sent.
HOT = 32
FLUSH_KEYS = 250_000
FLUSH_DOCS = 10_000

U = np.uint64
#: Odd multipliers of a common 64-bit finaliser. Fixed values.
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def _memo() -> Memo:
    kept = sys.__dict__.setdefault("_siftloom_words64", {})
    if not kept:
        kept[0] = Memo(xxhash.xxh64_intdigest, 50_000)
    return kept[0]


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words.

    A-Z are lower-cased and words are runs of other characters than blanks. Fewer words than
    ``size`` make one shingle; no words make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(_memo().__getitem__, words), dtype=U, count=len(words))
    k = min(size, len(w))
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        acc = mix(w[:n] + U(k))
        for j in range(1, k):
            acc = mix(acc + w[j : j + n] * M2)
    return np.unique(acc)


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least num/den on shingles of ``words`` words."""

    words: int = 5
    num: int = 80
    den: int = 100

    def most_apart(self, smaller: int) -> int:
        return (self.den - self.num) * smaller // self.num

    @cached_property
    def bands(self) -> list[tuple[int, int, int, int]]:
        """(least size, most size, blocks, slack) per band; sizes grow by a quarter a band."""
        out, at = [], 1
        while at < 1 << 40:
            most = max(at, at * 5 // 4 - 1)
            d = self.most_apart(most)
            slack = 0 if d == 0 else max(4, -(-d // 10))
            out.append((at, most, d + 1 + slack, slack))
            at = most + 1
        return out

    def bands_of(self, n: int) -> list[int]:
        """The set's own band, and those in whose pairs it can be the larger set."""
        own = int(np.searchsorted(self._starts, n, side="right")) - 1
        out, k = [own], own - 1
        while k >= 0 and self.bands[k][1] * self.den // self.num >= n:
            out.append(k)
            k -= 1
        return out

    @cached_property
    def _starts(self) -> np.ndarray:
        return np.array([b[0] for b in self.bands])

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Block keys of a set, their lowest byte the band; and (band, hot blocks that the slack covers).

        What a set leaves out, hot blocks included, is at most ``slack`` blocks, and all that a similar
        set leaves out of the shared ones is of the same kinds. So only a set that leaves out its blocks
        of one token may leave out hot ones, too.
        """
        out, spare = [], []
        low = h & U(0xFFFFFFFF)
        for band in self.bands_of(len(h)):
            _, _, blocks, slack = self.bands[band]
            block = ((h >> U(32)) * U(blocks)) >> U(32)
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            bits = np.bitwise_xor.reduceat(mix(low * M1 + M2), first)
            used = block[first]
            strong = np.diff(np.r_[first, len(block)]) > 1
            left = slack - (blocks - len(used))
            weak, covered = len(strong) - int(strong.sum()), 0
            if left < 0:
                lack = np.setdiff1d(np.arange(blocks, dtype=U), used)
                used, bits = np.r_[used, lack], np.r_[bits, np.zeros(len(lack), U)]
            elif weak <= left:
                used, bits, covered = used[strong], bits[strong], left - weak
            spare.append((band, covered))
            out.append(mix(bits ^ mix(used + (U(band) << U(40)))) & ~U(0xFF) | U(band))
        return np.concatenate(out), spare


def folded(h: np.ndarray) -> np.ndarray:
    """The sketch folded to 512 bits, as 8 signed integers."""
    bits = (np.bincount((h & U(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


ROWS = "kind byte, bucket int, a long, b long, n int, fp1 long, fp2 long, sketch array<long>, spare array<int>, xs binary, ys binary"
_TYPES = [pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
DOC, KEYS, MEMBER, EQUAL = range(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_TYPES), _TYPES, strict=True)], names=_NAMES)


def _shared(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids) of keys with two ids or more, and (key, smallest id) of every key."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if not len(keys):
        return keys, ids, keys, ids
    new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
    keys, ids = keys[new], ids[new]
    first = np.r_[True, keys[1:] != keys[:-1]]
    many = ~(first & np.r_[first[1:], True])
    return keys[many], ids[many], keys[first], ids[first]


def _sketched(docs: DataFrame, sim: Similarity, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_out, keys, ids, gathered, sets, turn = [], [], [], 0, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal gathered, turn
            rows = docs_out[:]
            k, i = (np.concatenate(keys), np.concatenate(ids)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))
            mk, mi, fk, fi = _shared(k, i)
            for at in range(0, len(mk), 20_000):
                turn += 1
                rows.append((MEMBER, turn % parts, None, None, None, None, None, None, None, mk[at : at + 20_000].tobytes(), mi[at : at + 20_000].tobytes()))
            to = ((fk >> U(8)) % U(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(parts + 1))
            fk, fi = fk[order], fi[order]
            rows += [(KEYS, p, None, None, None, None, None, None, None, fk[s:e].tobytes(), fi[s:e].tobytes()) for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
            docs_out.clear(), keys.clear(), ids.clear(), sets.clear()
            gathered = 0
            for at in range(0, len(rows), 4096):
                yield _batch(rows[at : at + 4096])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    turn += 1
                    h = shingles(text, sim.words)
                    n = len(h)
                    if n and doc is not None:
                        own = xxhash.xxh3_128_digest(h.tobytes())
                        fp1, fp2 = (int(x) for x in np.frombuffer(own, np.int64))
                        if own in sets:
                            docs_out.append((DOC, turn % parts, doc, None, n, fp1, fp2, None, None, None, None))
                            docs_out.append((EQUAL, turn % parts, doc, sets[own], None, None, None, None, None, None, None))
                            continue
                        sets[own] = doc
                        k, spare = sim.keys(h)
                        docs_out.append((DOC, turn % parts, doc, None, n, fp1, fp2, folded(h).tolist(), [x for s in spare for x in s], None, None))
                        keys.append(k)
                        ids.append(np.full(len(k), doc, np.int64))
                        gathered += len(k)
                    else:
                        docs_out.append((DOC, turn % parts, doc, None, n, None, None, None, None, None, None))
                    if gathered >= FLUSH_KEYS or len(docs_out) >= FLUSH_DOCS:
                        yield from flush()
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        none = None

        def members(k: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(k), 100_000):
                a, c = k[at : at + 100_000].view(np.int64), i[at : at + 100_000]
                cols = [pa.array(np.full(len(a), MEMBER, np.int8)), pa.nulls(len(a), pa.int32()), pa.array(a), pa.array(c), *(pa.nulls(len(a), t) for t in _TYPES[4:])]
                yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

        for b in batches:
            kind = b.column(0).to_numpy(zero_copy_only=False)
            for r in np.flatnonzero((kind == KEYS) | (kind == MEMBER)):
                k, i = np.frombuffer(b.column(9)[int(r)].as_py(), U), np.frombuffer(b.column(10)[int(r)].as_py(), np.int64)
                if kind[r] == KEYS:
                    keys.append(k)
                    ids.append(i)
                else:
                    yield from members(k, i)
            rest = np.flatnonzero((kind == DOC) | (kind == EQUAL))
            if len(rest):
                yield b.take(pa.array(rest))
        if keys:
            k, i, none, none = _shared(np.concatenate(keys), np.concatenate(ids))
            yield from members(k, i)

    return in_arrow(in_arrow(docs, run, ROWS).repartitionById(parts, "bucket"), gather, ROWS).drop("bucket", "xs", "ys")


def _close(x: str, y: str, sim: Similarity) -> Column:
    """Exact bounds: sizes allow the similarity, and folded sketches are no further apart than similar sets are."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(8)])
    return (large.cast("long") * sim.num <= small.cast("long") * sim.den) & (apart * sim.num <= small.cast("long") * (sim.den - sim.num))


def _verified(docs: DataFrame, pairs: DataFrame, sim: Similarity) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts have the similarity."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = written(picked(docs, written(ends, "ends"), "id"), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = None, None
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for a, b, ta, tb in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    if kept[0] != tb:
                        kept = tb, shingles(tb, sim.words)
                    x, y = shingles(ta, sim.words), kept[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and sim.den * both >= sim.num * (len(x) + len(y) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], []))], names=["a", "b"])

    return in_arrow(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def similar_components(docs: DataFrame, sim: Similarity | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: the size of its set of shingles and the
    smallest id that it reaches by links of the given similarity, itself included.

    Null and empty texts have no shingles and no links. Rows with a null id are counted but
    never linked (their component_id is null); rows that repeat an id are one node with all its
    texts' links. ``key`` must be integer. Other columns are left out; an empty table gives an
    empty one.
    """
    sim = sim or Similarity()
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    with scratch() as keep:
        rows, root = (keep(x) for x in _components(docs, sim))
    out = rows.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles")).join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _components(docs: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """Written tables: (id, n) of all rows, and (node, root) of those that have a link."""
    table = written(_sketched(docs, sim, shuffle_partitions(docs.sparkSession)), "sketches")
    rows = table.where(f"kind = {DOC}").select(F.col("a").alias("id"), "n", "fp1", "fp2", "sketch", "spare")
    sets = rows.where("sketch is not null")
    members = table.where(f"kind = {MEMBER}").select(F.col("a").alias("key"), F.col("b").alias("id"))
    equal = table.where(f"kind = {EQUAL} and a <> b").select("a", "b")

    pivots = members.groupBy("key").agg(F.min("id").alias("pivot"))
    star = members.join(pivots, "key").where("id > pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    x, y = sets.select(F.struct("*").alias("x"), F.col("id").alias("a")), sets.select(F.struct("*").alias("y"), F.col("id").alias("b"))
    known = star.join(x, "a").join(y, "b").where(_close("x", "y", sim)).select("a", "b", ((F.col("x.fp1") == F.col("y.fp1")) & (F.col("x.fp2") == F.col("y.fp2"))).alias("same"))
    star = written(known, "star")
    same = star.where("same").select("a", "b").unionByName(equal)
    links = written(_verified(docs, star.where("not same").select("a", "b").distinct(), sim).unionByName(same).distinct(), "links")
    root = written(components(links), "roots")

    # members of different components that share a block and were not compared
    placed = members.distinct().join(root.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("key", "size")
    placed = written(placed.join(mixed, "key").withColumn("band", F.col("key").bitwiseAND(F.lit(0xFF)).cast("int")), "mixed")
    covers = sets.select("id", F.posexplode("spare").alias("at", "band"), "spare").where("at % 2 = 0").select("id", "band", F.expr("spare[at + 1]").alias("covered"))
    hot = placed.where(f"size > {HOT}").groupBy("id", "band").agg(F.count("*").alias("n_hot"))
    light = hot.join(covers, ["id", "band"]).groupBy("id", "band").agg(F.max("n_hot").alias("n_hot"), F.min("covered").alias("covered")).where("n_hot <= covered").select("id", "band")
    hot_left = placed.where(f"size > {HOT}").join(light, ["id", "band"], "left_anti").select("key", "id", "root")
    left = placed.where(f"size <= {HOT}").select("key", "id", "root").unionByName(hot_left)
    left = left.groupBy("id").agg(F.min("root").alias("root"), F.collect_list("key").alias("keys")).join(sets.select("id", "n", "sketch"), "id")
    left = written(left.select("id", "root", "n", "sketch", few_of(F.col("keys")).alias("few"), F.explode("keys").alias("key")), "left")
    p, q = left.alias("x"), left.alias("y")
    more = p.join(q, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.id") > F.col("y.id")) & _close("x", "y", sim) & once("x.key", "x.few", "y.few"))
    more = more.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(star.select("a", "b"), ["a", "b"], "left_anti")
    more = written(more, "more")
    new = written(_verified(docs, more, sim), "links")
    if new.limit(1).count():
        root = written(components(links.unionByName(new)), "roots")
    return written(rows.select("id", "n"), "sizes"), root
