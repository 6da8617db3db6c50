import re
from collections import Counter

from siftloom.llm.quality_rules import judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    cov = {q for p, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for q in (p, p + 1, p + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cov), failed


def test_figures_equal_brute_force(spark):
    texts = [
        None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "# a* $%&|<>\n# a* $%&|<>\n\n\nend",
        "é ü z \x0b q\x0cr\x1cs", "the cat sat on the mat\n" * 40, "one two three " * 30, " ".join(f"w{i}" for i in range(60)), "lang " * 30000,
    ]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)] + [(0, None, "clash", 9)], "doc_id long, text string, _w string, quality int")
    rows = judge(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(r.text), r.text
        assert not (q.kept and q.base_failed) and r._w == "clash"
    assert judge(df.limit(0)).count() == 0


def test_plan_has_no_python_and_no_exchange(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


def test_filter_on_the_verdict(spark):
    """A filter neither multiplies the work nor changes the rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(r.doc_id for r in judge(docs).collect() if r.quality.kept)
    kept = judge(docs).where("quality.kept")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") <= 2 and "Python" not in plan
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want and 0 < len(want) < docs.count()
    assert kept.count() == len(want)
    assert judge(docs).where("quality.base_failed and quality.n_words >= 50").count() == sum(brute(r.text)[5] and brute(r.text)[0] >= 50 for r in docs.collect())


def test_very_long_text_and_ties(spark):
    """At the bounds of the base rules, and a text of 200,000 words."""
    texts = [" ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), " ".join([f"w{i}" for i in range(30)] + ["a b c"] * 10), " ".join([f"w{i}" for i in range(29)] + ["a b c"] * 10), " ".join(f"w{i % 60000}" for i in range(200000))]
    got = {r.doc_id: r.quality for r in judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all((q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(texts[i]) for i, q in got.items())
    assert [got[i].base_failed for i in range(5)] == [False, True, False, True, True]
