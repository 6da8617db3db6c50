"""Best-fit-decreasing packing of token sequences.

Pieces are placed by decreasing length, each into the open bin of the least remaining capacity
that still holds it; a segment tree over the remaining capacities finds that bin in
logarithmic time. Bins of equal capacity are interchangeable and so are pieces of equal
length, hence the tree works on counts: one step places a whole run of equal pieces, the plan
has a size bounded by the capacity and not by the corpus, and every piece finds its bin by its
rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Memo, byte_alphabet, required
from .common import in_arrow, written

CAPACITY = 4096

#: The tokenizer's split pattern. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The same for lower-case ASCII texts, which the standard library splits faster.
ASCII_WORDS = r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9]+"

#: Texts with other characters go to the library whole: its Unicode tables may differ from regex's.
USUAL = r"[^\x00-\u052f\u1e00-\u1eff\u2010-\u203a\u20a0-\u20b0\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"


class CapacityTree:
    """How many open bins have each remaining capacity; finds the tightest that holds a piece."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, at: int, n: int) -> None:
        k = at + self.leaves
        while k:
            self.count[k] += n
            k //= 2

    def tightest(self, least: int) -> int:
        """The least capacity of at least ``least`` that an open bin has, or -1."""
        k = least + self.leaves
        if self.count[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return -1


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(runs, bins): where best-fit decreasing puts ``histogram[length]`` pieces of each length.

    A run is (length, first rank, first bin, pieces a bin, offset): the pieces of this length
    from that rank on, up to the next run, fill the bins from the first one on, so many each,
    starting at the offset. Lengths must lie between 1 and ``capacity``.
    """
    tree = CapacityTree(capacity)
    free: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> [first bin, end)
    runs, bins = [], 0

    def put(cap: int, first: int, end: int) -> None:
        if end > first and cap:
            free.setdefault(cap, []).append((first, end))
            tree.add(cap, end - first)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 1 <= length <= capacity and left:
            raise ValueError(f"a piece of {length} tokens in sequences of {capacity}")
        while left:
            cap = tree.tightest(length)
            if cap < 0:
                # a new bin: it then is the tightest one until it holds no more of this length
                cap, each = capacity, capacity // length
                first, end = bins, bins + -(-left // each)
                bins = end
            else:
                each = cap // length
                first, end = free[cap].pop()
                tree.add(cap, first - end)
            use = min(end - first, -(-left // each))
            placed = min(left, use * each)
            runs.append((length, rank, first, each, capacity - cap))
            full = placed // each
            put(cap - each * length, first, first + full)
            if placed % each:
                put(cap - placed % each * length, first + full, first + full + 1)
            put(cap, first + use, end)
            left, rank = left - placed, rank + placed
    return np.array(runs, dtype=np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY, rows_a_task: int = 1_000_000) -> DataFrame:
    """``pieces`` plus sequence_id and offset.

    The histogram of lengths (at most ``capacity`` rows) goes to the driver and the plan of runs
    goes back. The rank of a piece among those of its length comes from salted counts: the salt
    is a hash of ``order`` and there are enough salts that no length, however hot, has more than
    some ``rows_a_task`` pieces in one group. ``pieces`` must give the same rows when read again
    (a written table). No rows give no sequences; null lengths are not allowed.
    """
    spark = pieces.sparkSession
    histogram = {int(r[0]): r[1] for r in pieces.groupBy(length).count().collect()}
    runs, _ = best_fit(histogram, capacity)
    salts = max(32, -(-max(histogram.values(), default=0) // rows_a_task))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(length, "__salt").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy(length).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))).drop("__n")
    ranked = salted.withColumn("__rank", F.row_number().over(W.partitionBy(length, "__salt").orderBy(*order)) - 1).join(before, [length, "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0))).drop("__before", "__salt")
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    sent = spark.sparkContext.broadcast(runs)  # of a size bounded by the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        key = (-plan[:, 0] << 44) + plan[:, 1]  # lengths decrease from run to run, ranks increase
        for b in batches:
            size, rank = (np.asarray(b.column(k).to_numpy(zero_copy_only=False), dtype=np.int64) for k in (0, 1))
            r = plan[np.searchsorted(key, (-size << 44) + rank, side="right") - 1] if len(plan) else plan
            at = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(r[:, 2] + at // r[:, 3]), pa.array(r[:, 4] + at % r[:, 3] * size)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "sequence_id long, offset long"])
    return in_arrow(ranked.select(F.col(length).alias("__l"), "__rank", *keep), run, schema)


class WordBPE:
    """Ids of the word-level BPE tokenizer at ``path``, as the tokenizers library gives them.

    The library's own model encodes each distinct word once; a bounded memo keeps the ids. A file
    with another normalizer or split into words is refused with a ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        required(spec, normalizer={"type": "Sequence", "normalizers": steps}, pre_tokenizer={"type": "Sequence"}, model={"type": "BPE", "dropout": None})
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        required(split, type="Split", pattern={"Regex": WORDS}, behavior="Removed", invert=True)
        required(level, type="ByteLevel", add_prefix_space=False, use_regex=False)
        tok = self.tok = Tokenizer.from_file(path)
        self.unusual = regex.compile(USUAL)
        self.model = tok.model
        self.letters = byte_alphabet()
        self.special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.words = regex.compile(WORDS)
        self.ascii_words = re.compile(ASCII_WORDS, re.ASCII)
        self.memo = Memo(self._word)

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):  # printable ASCII stands for itself
            letters = self.letters
            word = "".join([letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _plain(self, text: str) -> list[bytes]:
        if text.isascii():
            return list(map(self.memo.__getitem__, self.ascii_words.findall(text.lower())))
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return list(map(self.memo.__getitem__, self.words.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not text.isascii() and self.unusual.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "<|" not in text:
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(np.array([self.special[m[0]]], dtype="<u4").tobytes())
            at = m.end()
        return b"".join(out + self._plain(text[at:]))


def loaded(path: str) -> WordBPE:
    kept = sys.__dict__.setdefault("_siftloom_words", {})
    if path not in kept:
        kept[path] = WordBPE(path)
    return kept[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and ``end_id``, cut only where longer
    than ``capacity``. A null text counts as empty: its only token is ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = loaded(path), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(t) + end
                    out += [(k, p, s // 4, min(4 * capacity, len(ids) - s) // 4, ids[s : s + 4 * capacity]) for p, s in enumerate(range(0, len(ids), 4 * capacity))]
                cols = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return in_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, piece int, start long, length long, ids binary")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """A row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Other columns of ``docs`` are left out; repeated rows and null ids are packed like any other
    row; an empty table gives an empty one.
    """
    pieces = token_pieces(docs, path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(pieces, "pieces"), capacity=capacity)
