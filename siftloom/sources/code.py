"""Source code as a graph: modules, files and exported symbols; contains, imports and calls edges.

Files are read by Spark's binary source and parsed one by one by a small scanner that knows
strings, comments, templates, imports, exports and function scopes; everything between files
(resolving imports, binding uses to exported symbols, features) is joins.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import local_embedding
from ..plans.tables import saved
from .store import Runs, Store

#: Folders that are not source code, and the largest file that is read. Fixed values.
SKIPPED = "node_modules dist .git coverage .next public styles .github vendor build out target .venv .turbo".split()
MOST_BYTES = 1_000_000
NOT_FEATURES = ("Loading", "RootLayout", "Layout", "Metadata", "metadata", "ThemeProvider", "Toaster", "Provider")
PLAIN_MODULES = r"^(components/ui|lib|hooks|core)$"

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|(?P<template>`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|[\s\S])"""
)
_NOT_CALLED = set("if for while switch catch return typeof await function new in of void delete do else case throw yield import super".split())


@dataclass
class Parsed:
    imports: list[tuple[str, str | None, str | None]] = field(default_factory=list)  # (from, imported or None for default, local)
    exports: list[tuple[str, str, bool, str]] = field(default_factory=list)  # (name, kind, is default, first line)
    uses: set[str] = field(default_factory=set)


def _closing(tokens: list[tuple[str, str, int]], at: int) -> int:
    """Where the bracket at ``at`` closes."""
    depth = 0
    for i in range(at, len(tokens)):
        t = tokens[i][1]
        if tokens[i][0] == "mark":
            depth += (t in "([{") - (t in ")]}")
            if not depth:
                return i
    return len(tokens) - 1


def _bound(tokens: list[tuple[str, str, int]], start: int, end: int) -> set[str]:
    """Names that parameters or patterns bind: not types, defaults or keys that are renamed."""
    names, depth, skip = set(), 0, None
    for i in range(start, end):
        kind, t, _ = tokens[i]
        if kind == "mark":
            if skip is None and t in (":", "=") and not (t == ":" and depth):
                skip = depth
            depth += (t in "([{<") - (t in ")]}>")
            if skip is not None and (depth < skip or (t == "," and depth == skip)):
                skip = None
        elif kind == "name" and skip is None and not (depth and i + 1 < end and tokens[i + 1][1] == ":"):
            names.add(t)
    return names


def parse(source: str) -> Parsed:
    """Imports, exported symbols and free uses (called, constructed or rendered names that no scope around binds)."""
    out = Parsed()
    tokens = [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(source) if m.lastgroup not in ("space", "comment")]
    n = len(tokens)
    at = lambda i: tokens[i][1] if 0 <= i < n else ""
    name = lambda i: 0 <= i < n and tokens[i][0] == "name"
    scopes: list[tuple[int, int, set[str]]] = []
    methods: set[int] = set()
    skip_until, depth = -1, 0
    for i in range(n):
        t = at(i)
        if tokens[i][0] == "mark":
            depth += (t in "{") - (t in "}")
        if i <= skip_until:
            continue
        if t == "import" and depth == 0 and at(i + 1) != "(" and at(i + 1) != ".":
            j = i + 1
            names: list[tuple[str | None, str]] = []
            while j < n and tokens[j][0] != "string" and at(j) != ";":
                if name(j) and at(j) not in ("type", "from", "as") and j == i + 1:
                    names.append((None, at(j)))
                if at(j) == "{":
                    end = _closing(tokens, j)
                    for part in " ".join(at(k) for k in range(j + 1, end)).split(","):
                        w = [x for x in part.split() if x != "type"]
                        if w:
                            names.append((w[0], w[-1]))
                    j = end
                j += 1
            if j < n and tokens[j][0] == "string":
                path = at(j)[1:-1]
                out.imports += [(path, a, b) for a, b in names] or [(path, None, None)]
                skip_until = j
            continue
        if t == "export" and depth == 0:
            j, default = i + 1, False
            while at(j) in ("default", "async", "declare", "abstract"):
                default, j = default or at(j) == "default", j + 1
            kind = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "const": "var", "let": "var", "var": "var"}.get(at(j))
            j += 1
            if at(j) in ("*", "enum"):
                kind, j = "enum" if at(j) == "enum" else kind, j + 1
            if kind and name(j):
                line = re.sub(r"\s+", " ", source[tokens[i][2] :].split("\n")[0]).strip()[:140]
                out.exports.append((at(j), kind, default, line))
        # function scopes
        start = None
        if t == "function":
            j = i + 1
            while j < n and at(j) != "(":
                j += 1
            start = j
        elif t == "(" and i and name(i - 1) and at(i - 1) not in _NOT_CALLED and at(_closing(tokens, i) + 1) in ("{", ":"):
            end = _closing(tokens, i)
            k = end + 1
            if at(k) == ":":
                while k < n and at(k) not in ("{", ";", ",", ")", "=", "=>"):
                    k += 1
            if at(k) == "{" and at(i - 2) not in ("new", "function", ".", "=", "return", "(", "?"):
                start = i
                methods.add(i - 1)
        elif t == "=>":
            if name(i - 1):
                params = {at(i - 1)}
            else:
                j, d = i - 1, 0
                while j >= 0:
                    d += (at(j) == ")") - (at(j) == "(")
                    if at(j) == "(" and d == 0:
                        break
                    j -= 1
                params = _bound(tokens, j + 1, i - 1)
            if at(i + 1) == "{":
                scopes.append((i, _closing(tokens, i + 1), params))
            else:
                j, d = i + 1, 0
                while j < n:
                    d += (at(j) in ("(", "[", "{")) - (at(j) in (")", "]", "}"))
                    if d < 0 or (d == 0 and at(j) in (",", ";")):
                        break
                    j += 1
                scopes.append((i, j - 1, params))
        if start is not None and start < n:
            end = _closing(tokens, start)
            body = end + 1
            while body < n and at(body) not in ("{", ";"):
                body += 1
            if at(body) == "{":
                scopes.append((start, _closing(tokens, body), _bound(tokens, start + 1, end)))
    # declarations belong to the innermost function around them
    for i in range(n):
        if at(i) in ("const", "let", "var") and (name(i + 1) or at(i + 1) in "[{"):
            own = {at(i + 1)} if name(i + 1) else _bound(tokens, i + 2, _closing(tokens, i + 1))
        elif at(i) in ("function", "class") and name(i + 1):
            own = {at(i + 1)}
        else:
            continue
        around = [s for s in scopes if s[0] <= i <= s[1]]
        if around:
            max(around, key=lambda s: s[0])[2].update(own)
    for i in range(n):
        if not name(i) or at(i - 1) == "." or at(i) in _NOT_CALLED or i in methods:
            continue
        j = i + 1
        while at(j) == "." and name(j + 1):
            j += 2
        used = (at(j) == "(" and at(i - 1) != "function") or at(i - 1) == "new" or (at(i - 1) == "<" and at(i)[0].isupper() and (not name(i - 2) or at(i - 2) in _NOT_CALLED))
        if used and not any(s[0] <= i <= s[1] and at(i) in s[2] for s in scopes):
            out.uses.add(at(i))
    return out


ROWS = "path string, kind string, name string, other string, detail string, flag boolean"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the .ts and .tsx files below ``root``, relative to it; tests, types and large files left out."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ts*").load(root)
    rel = F.expr(f"substring(path, {len(prefix) + 2})")
    bad = "(^|/)(" + "|".join(re.escape(x) for x in SKIPPED) + r"|\.[^/]*)/"
    keep = rel.rlike(r"\.tsx?$") & ~rel.rlike(r"\.d\.ts$|\.(test|spec)\.tsx?$") & ~rel.rlike(bad) & (F.col("length") <= MOST_BYTES)
    return files.where(keep).select(rel.alias("path"), F.col("content").cast("string").alias("content"))


def _facts(files: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                p = parse(content or "")
                for spec, imported, local in p.imports:
                    if spec.startswith("@/"):
                        target = spec[2:]
                    elif spec.startswith("."):
                        target = re.sub(r"\.js$", "", posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)))
                    else:
                        continue
                    out.append((path, "import", local, target, imported, imported is None and local is not None))
                out += [(path, "export", name, kind, line, default) for name, kind, default, line in p.exports]
                out += [(path, "use", name, None, None, None) for name in p.uses]
            yield pd.DataFrame(out, columns=["path", "kind", "name", "other", "detail", "flag"])

    return files.mapInPandas(run, ROWS)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    features: DataFrame


def scan(files: DataFrame) -> Graph:
    """Nodes (key, kind, path, module, symbol, symbol_kind, signature, description, content_hash, risk_tier,
    risk_score), edges (src, dst, kind) without repeats, and features (slug, label, description, parent, member)."""
    facts = saved(_facts(files), "facts")
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    f = files.select("path", T.module_of(directory).alias("module"), T.content_hash(F.concat("path", "content")).alias("content_hash"))
    none = F.lit(None).cast("string")
    file_nodes = f.select(F.col("path").alias("key"), F.lit("file").alias("kind"), "path", "module", none.alias("symbol"), none.alias("symbol_kind"), none.alias("signature"), "content_hash")
    sym = facts.where("kind = 'export'").dropDuplicates(["path", "name"]).join(f, "path")
    symbols = sym.select(F.concat("path", F.lit("#"), "name").alias("key"), F.lit("symbol").alias("kind"), "path", "module", F.col("name").alias("symbol"), F.col("other").alias("symbol_kind"), F.col("detail").alias("signature"), T.content_hash(F.concat("path", "detail")).alias("content_hash"))
    mods = f.select("module").distinct().select(F.concat(F.lit("module:"), "module").alias("key"), F.lit("module").alias("kind"), F.col("module").alias("path"), "module", none.alias("symbol"), none.alias("symbol_kind"), none.alias("signature"), T.content_hash(F.col("module")).alias("content_hash"))
    nodes = mods.unionByName(file_nodes).unionByName(symbols)
    risk = T.code_risk(F.col("path"), F.col("module"), F.col("symbol"))
    nodes = nodes.select("*", T.card(F.col("path"), F.col("module"), F.col("symbol"), F.col("signature")).alias("description"), risk["tier"].alias("risk_tier"), risk["score"].alias("risk_score"))

    contains = f.select(F.concat(F.lit("module:"), "module").alias("src"), F.col("path").alias("dst")).unionByName(symbols.select(F.col("path").alias("src"), F.col("key").alias("dst")))
    imp = facts.where("kind = 'import'").select("path", F.col("name").alias("local"), F.col("other").alias("target"), F.col("detail").alias("imported"), F.col("flag").alias("is_default"))
    stem = F.regexp_replace("target", r"\.(ts|tsx|js)$", "")
    tries = F.array(F.col("target"), F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), F.concat(stem, F.lit("/index.ts")), F.concat(stem, F.lit("/index.tsx")))
    found = imp.select("target").distinct().select("target", F.posexplode(tries).alias("rank", "file")).join(f.select(F.col("path").alias("file")), "file").groupBy("target").agg(F.min_by("file", "rank").alias("file"))
    imp = imp.join(found, "target").where("file <> path")
    imports = imp.select(F.col("path").alias("src"), F.col("file").alias("dst"))
    default = sym.where("flag").groupBy(F.col("path").alias("file")).agg(F.min("name").alias("default_name"))
    used = facts.where("kind = 'use'").select("path", F.col("name").alias("local"))
    calls = imp.where("local is not null").join(used, ["path", "local"]).join(default, "file", "left")
    calls = calls.select(F.col("path").alias("src"), F.concat("file", F.lit("#"), F.when(F.col("is_default"), F.col("default_name")).otherwise(F.col("imported"))).alias("dst"))
    calls = calls.join(symbols.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst")
    edges = contains.withColumn("kind", F.lit("contains")).unionByName(imports.withColumn("kind", F.lit("imports"))).unionByName(calls.withColumn("kind", F.lit("calls"))).distinct()

    slug = lambda m: F.concat(F.lit("code."), F.regexp_replace(m, "/", "."))
    named = symbols.groupBy("module").agg(F.array_join(F.slice(F.array_sort(F.collect_list("symbol")), 1, 14), ", ").alias("names"))
    whole = mods.join(named, "module", "left").select(slug(F.col("module")).alias("slug"), F.col("module").alias("label"), F.concat("module", F.lit(" 모듈. 구성요소: "), F.coalesce("names", F.lit("(no exports)"))).alias("description"), none.alias("parent"), F.array("key").alias("members"))
    worthy = symbols.where(F.col("symbol_kind").isin("function", "class", "var") & F.col("symbol").rlike("^[A-Z]") & ~F.col("module").rlike(PLAIN_MODULES) & ~F.col("symbol").isin(*NOT_FEATURES))
    leaf = worthy.select(F.concat(slug(F.col("module")), F.lit("."), "symbol").alias("slug"), F.col("symbol").alias("label"), F.concat("symbol", F.lit(" ("), "module", F.lit("/"), F.regexp_extract("path", "[^/]*$", 0), F.lit("). "), "signature").alias("description"), slug(F.col("module")).alias("parent"), F.array("key", "path").alias("members"))
    return Graph(nodes, edges, whole.unionByName(leaf))


TABLES = ("code_nodes", "code_edges", "code_features")


def rebuild(store: Store, files: DataFrame, repo: str = "app") -> None:
    """Scan ``files`` and replace the graph of ``repo`` in ``store``: nodes, edges and features in one commit.

    code_nodes has the columns of ``scan`` with repo, v (the embedding of the description) and feature_ids (slugs
    of all features that a node is a member of). code_features has those found in code, with repo, origin and
    v; features of other origin, and all rows of other repositories, stay. A node whose description is as it was
    keeps its vector. If the scan or the writing fails, the former graph stays and the ledger of runs has the error.
    """
    with Runs(store.spark, store.root).run(f"code {repo}"):
        g = scan(files)
        ids = g.features.select("slug", F.explode("members").alias("key")).groupBy("key").agg(F.array_sort(F.collect_set("slug")).alias("feature_ids"))
        nodes = g.nodes.join(ids, "key", "left").withColumn("feature_ids", F.coalesce("feature_ids", F.array().cast("array<string>")))

        def replaced(table: str, version: str, rows: DataFrame, stays: Column | None = None) -> DataFrame:
            rows = rows.withColumn("repo", F.lit(repo))
            if not version:
                return rows
            other = F.col("repo") != repo
            return store.read(table, version=version).where(other if stays is None else other | stays).unionByName(rows, allowMissingColumns=True)

        def made(last: dict[str, str]) -> dict[str, DataFrame]:
            had = store.read("code_nodes", "repo string, key string, description string, v array<float>", last["code_nodes"] or None).where(F.col("repo") == repo)
            own = nodes.join(had.select("key", "description", "v"), ["key", "description"], "left")
            own = own.where("v is not null").unionByName(own.where("v is null").withColumn("v", local_embedding("description")))
            features = g.features.select("*", F.lit("code_derived").alias("origin"), F.lit("grounded").alias("state"), local_embedding("description").alias("v"))
            return {
                "code_nodes": replaced("code_nodes", last["code_nodes"], own), "code_edges": replaced("code_edges", last["code_edges"], g.edges),
                "code_features": replaced("code_features", last["code_features"], features, F.col("origin") != "code_derived"),
            }

        store.retried(TABLES, made)
