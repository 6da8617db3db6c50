"""URL filters: pattern rules indexed by their rarest literal token.

A rule is compiled to a regular expression and to the literal tokens that every URL it fits
must contain (whole host labels, whole path segments). The index files each rule under the
one of its tokens that the fewest rules share. A URL's tokens fetch the candidate rules, and
only those run their expressions.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Rule lists up to this length travel to the executors with the code; longer ones are joined.
MOST_SENT_RULES = 20_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"(?s)^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path) if self.path else '(?:/|$)'}"

    @property
    def tokens(self) -> list[str]:
        whole = self.path.split("/")[1:-1]  # the last piece may go on in the URL
        return sorted({f"h:{x}" for x in self.host.split(".")} | {f"p:{x}" for x in whole if x})


def rarest(rules: Iterable[UrlRule]) -> list[tuple[str, UrlRule]]:
    """(token, rule): each rule under its rarest token; ties go to the token first in order."""
    rules = list(dict.fromkeys(rules))
    uses = Counter(t for r in rules for t in r.tokens)
    return [(min(r.tokens, key=lambda t: (uses[t], t)), r) for r in rules]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or where there is no ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_tokens(host: str, path: str) -> set[str]:
    return {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path.split("/") if x}


class RuleIndex:
    def __init__(self, rules: Iterable[UrlRule]):
        self.by_token: dict[str, list[tuple]] = defaultdict(list)
        for token, r in rarest(rules):
            # longest first; of equally long ones block before allow, then by text
            self.by_token[token].append((-len(r.text), r.verdict != "block", r.text, r.verdict, re.compile(r.pattern)))

    def best(self, host: str, path: str) -> tuple[str | None, str | None]:
        whole, found = host + path, None
        for token in url_tokens(host, path):
            for c in self.by_token.get(token, ()):
                if (found is None or c[:3] < found[:3]) and c[4].match(whole):
                    found = c
        return (None, None) if found is None else (found[2], found[3])


def filter_urls(pages: DataFrame, rules: Iterable[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule and verdict; columns of these names are replaced.

    The longest rule that fits wins and gives its verdict, of equally long ones block before allow
    and then the first text in order; without one, rule is null and the verdict ``default``. A null URL or one without ``://`` has an empty host and path and fits
    no rule. One scan without an exchange: rows are judged independently, so hot hosts,
    repeated rows and ties need no care. An empty table or no rules work alike. More than
    ``MOST_SENT_RULES`` rules are joined by token instead (``join_rules``), with the same result.
    """
    rules = list(rules)
    if len(rules) > MOST_SENT_RULES:
        return join_rules(pages, rules, url, default)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    df = pages.select(F.col(url).alias("__url"), *keep)
    fields = {f.name: f for f in df.schema.fields}
    out = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        for b in batches:
            parts = [split_url(u) for u in b.column(0).to_pylist()]
            found = [index.best(*p) for p in parts]
            new = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] or default for f in found]]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x, pa.string()) for x in new)], names=[*keep, "host", "path", "rule", "verdict"])

    return in_arrow(df, run, (out + ", " if keep else "") + "host string, path string, rule string, verdict string")


def join_rules(pages: DataFrame, rules: list[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """The same for a rule list of any length: URL tokens are joined to the rules' tokens."""
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    table = spark.createDataFrame([(t, r.text, r.pattern, r.verdict) for t, r in rarest(rules)], "token string, rule string, pattern string, verdict string")
    at = F.locate("://", F.col("__u"))
    rest = F.when(at > 0, F.expr("substring(__u, locate('://', __u) + 3)"))
    df = pages.select(F.col(url).alias("__u"), F.struct(*[F.col(c) for c in keep]).alias("__row")).withColumn("__r", rest)
    df = df.withColumn("__h", F.coalesce(F.regexp_extract("__r", r"^[^/?#]*", 0), F.lit("")))
    df = df.withColumn("path", F.coalesce(F.regexp_extract(F.expr("substring(__r, length(__h) + 1)"), r"^[^?#]*", 0), F.lit("")))
    df = df.withColumn("host", F.translate("__h", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    urls = df.select("host", "path").distinct()
    tokens = F.array_distinct(F.concat(F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x)), F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), x))))
    hits = urls.select("host", "path", F.explode(tokens).alias("token")).join(table, "token").where(F.expr("concat(host, path) rlike pattern"))
    order = F.struct(-F.length("rule"), F.col("verdict") != "block", F.col("rule"))  # that of RuleIndex
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), order).alias("__b"))
    out = df.join(best, ["host", "path"], "left")
    return out.select("__row.*", "host", "path", F.col("__b.rule").alias("rule"), F.coalesce("__b.verdict", F.lit(default)).alias("verdict"))
