import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siftloom.llm.fill_middle import GRAMMARS, Marks, Rates, fill_in_middle, pieces, restored

TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "a\r\nb c\n", "𝒳\n\U0001f600é́\nz", "<", "x<P", "S>\n<S", "has <M> in\nit", "<P>", "dup\n" * 3, "tail<\n>\nP>", "\x00a\nb\x00", "l\n" * 5000, "one. Two!  three?\n\nfour.five\n\n\n six", "  lead word\tx ", " \n"]

#: What a unit is, as the units themselves instead of the boundaries between them.
UNITS = {
    "line": r"[^\n]*\n|[^\n]+",
    "character": r"(?s).",
    "word": r"\A[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*",
}


def expected(key, text, rates=Rates(), marks=Marks()):
    t = text or ""
    u = re.findall(UNITS["line"], t)
    n = len(u)
    h = hashlib.sha256(f"{rates.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(m in t for m in (marks.prefix, marks.suffix, marks.middle)) or h3 % 100 >= rates.rewritten:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < rates.spm:
        return n, "spm", len(p), len(m), f"{marks.suffix}{s}{marks.prefix}{p}{marks.middle}{m}"
    return n, "psm", len(p), len(m), f"{marks.prefix}{p}{marks.suffix}{s}{marks.middle}{m}"


@pytest.mark.parametrize("rates", [Rates(), Rates(rewritten=40, spm=80, seed=3)])
def test_equals_a_plain_version_and_is_undone(spark, rates):
    rows = [(100 * r + i, t, f"x{i}", 1) for r in range(3) for i, t in enumerate(TEXTS)] + [(5, "again\nb\n", "y", 2), (5, "a\n", "y", 2), (None, "no\nkey\n", None, None)]
    # columns of the table may be called like those of the result
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    out = fill_in_middle(df, rates=rates).withColumn("back", restored(F.col("fim.output"), F.col("fim.form")))
    assert out.columns == ["doc_id", "text", "form", "n", "fim", "back"]
    seen = set()
    for r in out.collect():
        assert tuple(r.fim) == expected(r.doc_id, r.text, rates)
        assert r.back == (r.text or "")
        seen.add(r.fim.form)
    assert seen == {"plain", "psm", "spm"}


def test_marks_of_other_texts(spark):
    marks = Marks("<|fim_prefix|>", "[S*]", "$(")
    df = spark.createDataFrame([(i, f"a{i}\nb<P>\nc\n[S]*\n") for i in range(30)], "doc_id long, text string")
    out = fill_in_middle(df, marks=marks).withColumn("back", restored(F.col("fim.output"), F.col("fim.form"), marks))
    for r in out.collect():
        assert tuple(r.fim) == expected(r.doc_id, r.text, marks=marks) and r.back == r.text


@pytest.mark.parametrize("unit", sorted(GRAMMARS))
def test_units_join_to_the_text(spark, unit):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for t, u in df.select("t", pieces(F.col("t"), unit)).collect():
        assert "".join(u) == (t or "") and all(u)
        if unit in UNITS:
            assert u == re.findall(UNITS[unit], t or "")


def test_sentences_and_paragraphs(spark):
    df = spark.createDataFrame([("one. Two!  three?\n\nfour.five\n\n\n six",)], "t string")
    assert df.select(pieces(F.col("t"), "sentence")).first()[0] == ["one. ", "Two!  ", "three?\n\n", "four.five\n\n\n six"]
    assert df.select(pieces(F.col("t"), "paragraph")).first()[0] == ["one. Two!  three?\n\n", "four.five\n\n\n", " six"]


def test_no_exchange_and_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_clashing_name(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle(df).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(df.withColumn("fim", F.lit(1)))


def test_marks_that_overlap_are_refused():
    for m in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "d"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            Marks(*m)
