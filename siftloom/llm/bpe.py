"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that BPE puts last. An
automaton (a trie of the vocabulary with suffix links) lists the tokens that are suffixes of
each prefix; a token t ending there is the last one if the last token of the prefix before t
and t are compatible, that is if BPE applied to both together keeps them apart. The tokens
found are stored per prefix, and following them back from the end gives BPE's exact ids.

Pieces are the pre-tokenizer's words. A bounded memo keeps the ids of pieces met before.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: The pre-tokenizer's pattern. Fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Memos are emptied when they hold so many entries.
MOST_KEPT = 200_000
#: A longer piece is worked out each time rather than kept.
LONGEST_KEPT = 64

NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary's file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Memo(dict):
    """A dict that works out what it lacks and never grows beyond a bound."""

    def __init__(self, work, most: int = MOST_KEPT):
        self.work, self.most = work, most

    def __missing__(self, key):
        value = self.work(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


#: Settings of a BPE model that no tokenizer here may have.
PLAIN = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")


def required(spec: object, **wanted: object) -> None:
    """Raises an error where a tokenizer's ``spec`` differs from ``wanted``; unset, null and false are alike."""
    for name, value in wanted.items():
        own = spec.get(name) if isinstance(spec, dict) else None
        if isinstance(value, dict) and isinstance(own, dict):
            required(own, **value)
        elif (own or None) != (value or None):
            raise ValueError(f"a tokenizer with {name} = {own!r} is not supported, only {value!r}")


class ByteBPE:
    """Encodes and decodes with the byte-level BPE tokenizer described by the file at ``path``.

    A file of another kind (a normalizer, another split into pieces, dropout and the like) is
    refused with a ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        required(spec, normalizer=None, pre_tokenizer={"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, model={"type": "BPE", **dict.fromkeys(PLAIN)})
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        self.letters = letters
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank of their merge)
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(vocab[a + b], (*pair, self.rank[pair]))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or self._whole(i):
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.memo = Memo(self._piece)

    def _whole(self, token: int) -> bool:
        """Whether BPE makes this one token of the token's own bytes."""
        if token not in self.parts:
            return False
        left, right, _ = self.parts[token]
        return all(x not in self.parts or self._whole(x) for x in (left, right)) and self._apart(left, right, self.parts[token][2])

    def _apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge of a rank below ``until`` crosses the border between tokens a and b.

        The pieces at the border are those that are left when both tokens' merges are undone
        from the latest on. A pair at the border merges if its rank comes before the merges that
        consume either piece: of equal ranks the left one goes first.
        """
        left_until, right_until = until, until
        while True:
            r = self.rank.get((a, b), NEVER)
            if r < left_until and (r < right_until or r == right_until < until):
                return False
            la, rb = self.parts.get(a), self.parts.get(b)
            if la is None and rb is None:
                return True
            # undo the later of the two merges; the right token's goes back first of equal ranks
            if rb is None or (la is not None and la[2] > rb[2]):
                a, left_until = la[1], la[2]
            else:
                b, right_until = rb[0], rb[2]

    def _compatible(self, a: int, b: int) -> bool:
        key = a, b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) >= MOST_KEPT:
                self.fits.clear()
            ok = self.fits[key] = self._apart(a, b)
        return ok

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece as little-endian 32-bit integers."""
        letters = self.letters
        word = "".join([letters[b] for b in piece.encode()])
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        done = -1  # the prefix whose last token is settled; its longer candidates come first
        for end, (token, length) in self.automaton.iter(word):
            if end == done:
                continue
            before = last[end + 1 - length]
            if end + 1 == length or (before >= 0 and self._compatible(before, token)):
                last[end + 1], size[end + 1], done = token, length, end
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return np.array(out[::-1], dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers; special tokens' strings become their ids."""
        if not text:
            return b""
        get = self.memo.__getitem__
        if self.special_pattern is None or not self.special_pattern.search(text):
            return b"".join(map(get, self.pieces.findall(text)))
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += map(get, self.pieces.findall(text[at : m.start()]))
            out.append(np.array([self.special[m[0]]], dtype="<u4").tobytes())
            at = m.end()
        out += map(get, self.pieces.findall(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids' bytes; what is no UTF-8 becomes replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def loaded(path: str) -> ByteBPE:
    """One tokenizer per worker process and path."""
    kept = sys.__dict__.setdefault("_siftloom_bpe", {})
    if path not in kept:
        kept[path] = ByteBPE(path)
    return kept[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` without ``text``, plus ids (binary, little-endian 32-bit) and decoded (or null).

    Whole texts, one Arrow scan without an exchange. Null and empty texts have no ids and decode
    to an empty text. Repeated rows are encoded alike, an empty table gives an empty one, and
    columns named ids or decoded are replaced. ``path`` must exist on every executor.
    """
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column(0).to_pylist()]
                back = [bpe.decode(x) if decode else None for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=[*keep, "ids", "decoded"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids binary, decoded string"])
    return in_arrow(docs.select(F.col(text).alias("__text"), *keep), run, schema)
