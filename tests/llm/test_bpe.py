import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftloom.llm.bpe import ByteBPE, encode_texts
from siftloom.llm.packing import WordBPE
from siftloom.llm.q_bpe import op3_bpe, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return ByteBPE(PATH), Tokenizer.from_file(PATH)


def test_ids_and_text_equal_the_library(both):
    own, lib = both
    rng = random.Random(0)
    letters = "aaaabbcdeethis ing\n\t  'sre!!==--__0012.é漢字😀 \u0085"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "=" * 999, "-" * 5001, " " * 77, "a" * 3000, "\x00\x7f"]
    texts += [f"a {c}b 1{c}1 .'{c} " for c in map(chr, [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 97)])]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_every_prefix_ends_in_the_token_that_bpe_puts_last(both):
    own, lib = both
    text = "unbelievablyinterconnectednesses"
    for n in range(1, len(text) + 1):
        assert np.frombuffer(own.encode(text[:n]), "<u4")[-1] == lib.encode(text[:n]).ids[-1]


def test_query_and_rows(spark, tmp_path, both):
    _, lib = both
    texts = [None, "", "héllo world", "héllo world", "word " * 30000]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, ids binary")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op3_bpe(spark, str(tmp_path)).collect():
        t = texts[r.doc_id] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert encode_texts(docs, vocabulary("byte_bpe_50k.json")).columns == ["doc_id", "ids", "decoded"]
    assert encode_texts(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize(("kind", "name"), [(ByteBPE, "byte_bpe_50k.json"), (WordBPE, "word_bpe_49k.json")])
def test_other_kinds_of_tokenizers_are_refused(tmp_path, kind, name):
    spec = json.load(open(public_tokenizers.path(name), encoding="utf-8"))
    kind(public_tokenizers.path(name))
    changes = [("normalizer", {"type": "NFKC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("model", spec["model"] | {"dropout": 0.1})]
    for part, value in changes:
        with open(tmp_path / "t.json", "w", encoding="utf-8") as f:
            json.dump(spec | {part: value}, f)
        with pytest.raises(ValueError, match="not supported"):
            kind(str(tmp_path / "t.json"))
