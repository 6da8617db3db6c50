import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftloom.llm.packing import CapacityTree, WordBPE, best_fit, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, c in enumerate(bins) if c >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_one_by_one_packing(seed):
    rng = random.Random(seed)
    cap = rng.choice([5, 16, 37, 100])
    lengths = [rng.choice([rng.randint(1, cap), 1 + cap // 3, cap]) for _ in range(rng.randint(0, 300))]
    runs, bins = best_fit(Counter(lengths), cap)
    used = Counter()
    for k, (n, rank, first, each, offset) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else Counter(lengths)[n]
        for at in range(end - rank):
            assert used[first + at // each] == offset + at % each * n
            used[first + at // each] += n
    assert sorted(cap - used[k] for k in range(bins)) == plain_best_fit(lengths, cap)


def test_tree_finds_the_tightest():
    t = CapacityTree(10)
    for c in (3, 7, 7, 10):
        t.add(c, 1)
    assert [t.tightest(n) for n in (1, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    t.add(10, -1)
    assert t.tightest(8) == -1


def test_words_equal_the_library():
    own, lib = WordBPE(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(0)
    letters = "aaaabbcdeethis ing\n\t  'srAE!!==--__0012.é漢字😀 \u0085Σσİ́̇ſK'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["", "X<|ENDOFTEXT|>", "x<|endoftext|> y<|startoftext|><|endoftext|>", "<|endoft<|endoftext|>ext|>", "-" * 3000]
    texts += [f"a {c}b 1{c}1 .'{c} e{c}" for c in map(chr, [*range(0, 0xD800, 5), *range(0xE000, 0x110000, 97)])]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == e.ids, t


def test_documents_are_whole_and_gapless(spark):
    lib = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = [None, "", "hot copy of a text"] + ["hot copy of a text"] * 50 + [" ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.choice([3, 40, 90, 400]))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0), (3, "again", 0)], "doc_id long, text string, offset int")
    rows = pack_documents(docs, PATH, capacity=64).collect()
    own = sorted((r for r in rows if r.doc_id is not None and r.doc_id != 3), key=lambda r: (r.doc_id, r.piece))
    for i, t in enumerate(texts):
        if i == 3:
            continue
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        cut = [ids[s : s + 64] for s in range(0, len(ids), 64)]
        got = [r for r in own if r.doc_id == i]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(p, 64 * p, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for p, c in enumerate(cut)]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) == len(plain_best_fit([r.length for r in rows], 64))
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_hot_length_with_many_salts(spark):
    rows = spark.createDataFrame([(i, 0, 5 if i % 3 else 7) for i in range(3000)], "doc_id long, piece int, length long")
    out = pack(rows, capacity=16, rows_a_task=10).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 3000
    assert len({r.sequence_id for r in out}) == len(plain_best_fit([r.length for r in out], 16))
