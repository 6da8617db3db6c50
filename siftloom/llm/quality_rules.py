"""Quality rules: a table of thresholds compiled into one projection.

Every figure is a built-in expression over the text (no user functions), so the whole
table is judged in one scan without any exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

#: Frequent short words of English, German, French and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it as with on be by this was are at or an not from "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des du et un une est que pour dans qui sur au par en ne se pas "
    "el los las y del por con una su para es al lo como más o"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``ratio`` of the figures must lie within [least, most]; an open end is None."""

    name: str
    over: str
    under: str
    least: float | None = None
    most: float | None = None


#: The default table. A text of no words fails by its length in the base check already.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    Rule("stop_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("short_line_ratio", "n_short_lines", "n_lines", None, 0.9),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once.

    A lambda binds it within one expression. A chain of columns would be put into each other by a
    filter on the result, and worked out many times over.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(w: Column) -> Column:
    """Words of ``w`` within windows of three that occur twice or more."""
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def starts(s: Column) -> Column:
        again = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(again(x, i), x["p"])), lambda x: x.isNotNull()))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    placed = lambda t: F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    some = lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), _let(placed(t), lambda s: _let(starts(s), cover))).otherwise(F.lit(0))
    return _let(windows, some)


def figures(text: Column) -> Column:
    """A struct of counts that rules may name, as one expression.

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_short_lines
    (lines of one or two words), n_stop_words and n_repeat_words; a null text counts as empty
    and gives zeros. Texts are read whole; work is linear in their length but for one sort of
    a text's own word triples.
    """
    def counts(t: Column, w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[" + SYMBOLS.replace("&", r"\&") + "]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: ~x.rlike(r"[^\x20\x09-\x0D][\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]"))).cast("long").alias("n_short_lines"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _covered(w).cast("long").alias("n_repeat_words"),
        )

    words = lambda t: F.array_remove(F.split(t, BLANKS), "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(words(t), lambda w: _let(lines(t), lambda x: counts(t, w, x))))


def compiled(q: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: every rule's ratio of the figures ``q`` within its bounds (0/0 counts as 0)."""
    ok = F.lit(True)
    for r in rules:
        ratio = q[r.over] / F.greatest(q[r.under], F.lit(1))
        if r.least is not None:
            ok = ok & (ratio >= r.least)
        if r.most is not None:
            ok = ok & (ratio <= r.most)
    return ok


#: The counts of ``figures``.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_short_lines", "n_stop_words", "n_repeat_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """``docs`` plus ``quality``: a struct of the figures, base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_pct`` percent of
    the words within repeated word triples. kept: not base_failed and within all rules. Null
    and empty texts have no words and fail. Repeated rows are judged alike, other columns are
    left as they are (but for one named quality, which is replaced), an empty table gives an
    empty one. A filter on the verdict works a text out once, and once more if it is kept and
    its figures are read.
    """
    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > max_repeat_pct * q["n_words"])
        return F.struct(*[q[c].alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & compiled(q, rules)).alias("kept"))

    keep = [docs[c] for c in docs.columns if c != "quality"]
    return docs.select(*keep, _let(figures(docs[text]), verdict).alias("quality"))
