r"""Fill-in-the-middle rewriting of documents.

A text is cut into units, two unit boundaries are drawn from a hash of its id, and the pieces
before, between and behind them are written in another order with a mark before each. A unit
grammar is a regular expression of zero width: it states which class of characters stands on
either side of a boundary, so that splitting a text there loses nothing. All of it is one Spark
projection: no exchange, no user function, and each text is held once with its pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries of each kind of unit; a boundary never is at an end of the text.
#: A line ends with \n, a paragraph with a run of \n\n, a sentence with its mark and the blanks behind it,
#: a word with the blanks behind it (blanks that open a text are a unit); a character is a code point.
GRAMMARS = {
    "line": r"(?<=\n)(?!\z)",
    "paragraph": r"(?<=\n\n)(?=[^\n])",
    "sentence": r"(?<=[.!?][\x20\x09-\x0D]{1,8})(?=[^\x20\x09-\x0D])",
    "word": r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])",
    "character": r"(?!\A)(?![\x{DC00}-\x{DFFF}])(?!\z)",
}


@dataclass(frozen=True)
class Marks:
    """Texts that open the parts. A document that contains one of them stays as it is.

    No mark may end as a mark begins, or one could arise across the end of a part.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        overlap = any(a[:i] == b[-i:] for a in marks for b in marks for i in range(1, max(len(a), len(b))))
        contained = any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j)
        if not all(marks) or overlap or contained:
            raise ValueError("marks must not be empty, equal or overlap")


@dataclass(frozen=True)
class Rates:
    """Percent of texts that are rewritten, percent of those in the order suffix, prefix, middle, and the seed."""

    rewritten: int = 100
    spm: int = 50
    seed: int = 7


def pieces(text: Column, unit: str = "line") -> Column:
    """The units of ``text`` in order; joined they are the text. Null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GRAMMARS[unit], -1))


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits: the leading groups of the hex SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")).cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rewritten(text: Column, key: Column, unit: str = "line", marks: Marks = Marks(), rates: Rates = Rates()) -> Column:
    """struct(n, form, prefix_chars, middle_chars, output) of a text.

    n is the number of units; form is plain, psm or spm; the lengths count code points and are null
    for a plain text, whose output is the text itself. Texts that are null (taken as empty), empty or
    hold a mark are plain. A null key is drawn for like an empty one; rows that repeat a key are drawn
    for alike. Both boundaries may coincide or lie at an end, which makes empty parts.
    """
    t = F.coalesce(text, F.lit(""))
    h1, h2, h3, h4 = _draws(key, rates.seed)
    held = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        held = held | t.contains(m)
    form = F.when((t == "") | held | (h3 % 100 >= rates.rewritten), "plain").when(h4 % 100 < rates.spm, "spm").otherwise("psm")

    def built(x: Column) -> Column:
        u, n = x["units"], F.size(x["units"])
        a, b = h1 % (n + 1), h2 % (n + 1)
        low, high = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
        cut = F.struct(
            F.array_join(F.slice(u, F.lit(1), low), "").alias("prefix"), F.array_join(F.slice(u, low + 1, high - low), "").alias("middle"),
            F.array_join(F.slice(u, high + 1, n - high), "").alias("suffix"), x["form"].alias("form"), n.cast("long").alias("n"),
        )
        return _bind(cut, written_out)

    def written_out(c: Column) -> Column:
        p, m, s = c["prefix"], c["middle"], c["suffix"]
        plain = c["form"] == "plain"
        spm = F.concat(F.lit(marks.suffix), s, F.lit(marks.prefix), p, F.lit(marks.middle), m)
        psm = F.concat(F.lit(marks.prefix), p, F.lit(marks.suffix), s, F.lit(marks.middle), m)
        length = lambda x: F.when(~plain, F.length(x).cast("long"))
        return F.struct(
            c["n"].alias("n"), c["form"].alias("form"), length(p).alias("prefix_chars"), length(m).alias("middle_chars"),
            F.when(plain, F.concat(p, m, s)).when(c["form"] == "spm", spm).otherwise(psm).alias("output"),
        )

    return _bind(F.struct(pieces(text, unit).alias("units"), form.alias("form")), built)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that ``rewritten`` made ``output`` of, cut out of it at its marks.

    Each mark occurs once in a rewritten text: parts hold none, and the marks cannot overlap a part's end.
    """
    quoted = "|".join(rf"\Q{m}\E" for m in (marks.prefix, marks.suffix, marks.middle))
    back = lambda x: F.when(form == "spm", F.concat(F.get(x, 2), F.get(x, 3), F.get(x, 1))).otherwise(F.concat(F.get(x, 1), F.get(x, 3), F.get(x, 2)))
    return F.when(form == "plain", output).otherwise(_bind(F.split(output, quoted, -1), back))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", marks: Marks = Marks(), rates: Rates = Rates(), into: str = "fim") -> DataFrame:
    """``docs`` with the struct column ``into`` (see ``rewritten``); its own columns stay as they are.

    A column of ``docs`` that is called ``into`` already is an error, as it would be lost. An empty table gives an empty one.
    """
    if into in docs.columns:
        raise ValueError(f"the table has a column {into} already")
    return docs.withColumn(into, rewritten(docs[text], docs[key], unit, marks, rates))
