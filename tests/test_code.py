from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftloom.operators import insight as I
from siftloom.operators.analytics import module_blast, module_imports
from siftloom.sources.code import TABLES, parse, read_files, rebuild, scan
from siftloom.sources.store import Runs, Store
from siftloom.streaming.incremental import unique_reviews, upsert_stream, windowed_counts

FILES = {
    # a basket that adds prices: one module of plain functions, one of screens
    "src/hooks/money.ts": "/* amounts are in cents */\nexport const toCents = (euros: number) => Math.round(euros * 100);\nexport default class Ledger { total = 0; add(x: number): void { this.total += x; } }\nfunction hidden() { return toCents(1); }\n",
    "src/shop/basket.ts": "import Ledger, { toCents } from '../hooks/money';\nexport class Basket { private book = new Ledger(); put(price: number): void { this.book.add(toCents(price)); } }\n",
    # the name is bound anew: by a variable, by a parameter, by a pattern
    "src/shop/discount.ts": "import { toCents } from '../hooks/money';\nexport const half = (price: number) => { let toCents = (x: number) => x / 2; return toCents(price); };\n",
    "src/shop/stamp.ts": "import { toCents } from '../hooks/money';\nexport const stamp = ({ toCents }: { toCents: (x: number) => number }) => toCents(3);\n",
    # bound in one function, free in another one
    "src/shop/receipt.ts": "import { toCents as cents } from '../hooks/money';\nconst test = (cents: (x: number) => number) => cents(0);\nexport async function receipt(price: number) { await test((x) => x); return `${price}` + cents(price); }\n",
    "src/shop/panel/index.tsx": "import type { Basket } from '@/src/shop/basket';\nexport const Panel = ({ basket }: { basket: Basket }) => <p>{String(basket)}</p>;\nexport class Drawer {}\n",
    "src/shop/window.tsx": "import { Panel as Side } from './panel';\nexport const Window = () => { return <Side basket={null} />; }\n",
    "src/shop/basket.test.ts": "export const no = 1;", "src/shapes.d.ts": "export const no = 1;", "node_modules/left/pad.ts": "export const no = 1;", "src/.cache/old.ts": "export const no = 1;",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return scan(read_files(spark, str(root)))


def test_rebuild_replaces_one_repository_at_once(spark, graph, tmp_path):
    store = Store(spark, str(tmp_path))
    files = spark.createDataFrame([(k, v) for k, v in FILES.items() if k.startswith("src/shop/") and "test" not in k] + [("src/hooks/money.ts", FILES["src/hooks/money.ts"])], "path string, content string")
    rebuild(store, files)
    nodes = {r.key: r for r in store.read("code_nodes").collect()}
    assert set(nodes) == {r.key for r in graph.nodes.collect()} and all(r.repo == "app" and abs(sum(x * x for x in r.v) - 1) < 1e-4 for r in nodes.values())
    members = {}
    for f in store.read("code_features").collect():
        for m in f.members:
            members.setdefault(m, set()).add(f.slug)
    assert any(len(v) > 1 for v in members.values()) and all(set(r.feature_ids) == members.get(k, set()) for k, r in nodes.items())
    store.append("code_features", store.read("code_features").limit(1).withColumn("slug", F.lit("gap:app:x")).withColumn("origin", F.lit("review_emergent")))
    rebuild(store, files.where("path like '%money%'"), "other")
    counts = lambda: {t: {r.repo: r["count"] for r in store.read(t).groupBy("repo").count().collect()} for t in TABLES}
    before = counts()
    # a rebuild that fails midway leaves the former graph, and its run row
    broken = files.withColumn("content", F.expr("if(path like '%basket%', raise_error('no such blob'), content)"))
    with pytest.raises(Exception, match="no such blob"):
        rebuild(store, broken)
    assert counts() == before and before["code_nodes"]["app"] == len(nodes)
    assert sorted((r.name, r.status) for r in Runs(spark, str(tmp_path)).table().collect()) == [("code app", "done"), ("code app", "failed"), ("code other", "done")]
    rebuild(store, files.where("path like '%money%'"))
    after = counts()
    assert after["code_nodes"]["app"] == after["code_nodes"]["other"] < len(nodes) and store.read("code_features").where("origin = 'review_emergent'").count() == 1


def test_edges(graph):
    e = {(r.src, r.dst, r.kind) for r in graph.edges.collect()}
    money = "src/hooks/money.ts"
    assert {(a, b) for a, b, k in e if k == "calls"} == {("src/shop/basket.ts", f"{money}#toCents"), ("src/shop/basket.ts", f"{money}#Ledger"), ("src/shop/receipt.ts", f"{money}#toCents"), ("src/shop/window.tsx", "src/shop/panel/index.tsx#Panel")}
    assert {(a, b) for a, b, k in e if k == "imports"} == {(f"src/shop/{x}.ts", money) for x in ("basket", "discount", "stamp", "receipt")} | {("src/shop/window.tsx", "src/shop/panel/index.tsx"), ("src/shop/panel/index.tsx", "src/shop/basket.ts")}
    assert ("module:shop", "src/shop/basket.ts", "contains") in e and (money, f"{money}#Ledger", "contains") in e and not any(b.endswith("#hidden") for _, b, _ in e)


def test_nodes_and_features(graph):
    nodes = {r.key: r for r in graph.nodes.collect()}
    assert {r.path for r in nodes.values() if r.kind == "file"} == {k for k in FILES if not any(x in k for x in (".test.", ".d.", "node_modules", ".cache"))}
    assert nodes["src/hooks/money.ts#toCents"].signature == "export const toCents = (euros: number) => Math.round(euros * 100);" and len(nodes["module:hooks"].content_hash) == 16
    f = {r.slug: r for r in graph.features.collect()}
    assert set(f) == {"code.hooks", "code.shop", "code.shop.panel", "code.shop.Basket", "code.shop.Window", "code.shop.panel.Panel", "code.shop.panel.Drawer"}
    assert f["code.shop.panel.Panel"].parent == "code.shop.panel" and f["code.hooks"].description == "hooks 모듈. 구성요소: Ledger, toCents"


def test_impact_of_modules(graph):
    arts = graph.nodes.select(F.col("key").alias("id"), "module", "path", "risk_tier", "risk_score")
    assert {r.module: r.imports for r in module_imports(graph.edges, arts).collect()} == {"shop": ["hooks", "shop/panel"], "shop/panel": ["shop"]}
    assert {r.module: r.dependents for r in module_blast(graph.edges, arts).collect()} == {"hooks": 4, "shop/panel": 1, "shop": 1}


def test_parser_details():
    p = parse("import X, { a as b } from './m';\nimport './side';\nexport default class Foo { run(x: number): void { b(x); x(); } }\n// c()\nconst s = 'q()';\nconst t = `z()`;\nnew X(); ns.deep.call();")
    assert set(p.imports) == {("./m", None, "X"), ("./m", "a", "b"), ("./side", None, None)}
    assert p.uses == {"b", "X", "ns"} and p.exports[0][:3] == ("Foo", "class", True)
    assert parse("").uses == set() and parse("const f = a => a(); f((b) => { b() })").uses == {"f"}


def test_proposals(spark):
    now = F.lit("2026-05-26").cast("timestamp")
    d = lambda n: datetime(2026, 5, n)
    members = spark.createDataFrame([(1, "r1", d(20), "high", "pay", "2.4", "boom", ["a1"]), (1, "r2", d(21), "critical", "pay", "2.5", "again", []), (2, "r3", d(2), "low", "map", "2.4", "slow map", [])], "group_id long, review_id string, created_at timestamp, severity string, feature_id string, app_version string, text string, artifact_ids array<string>")
    reports = spark.createDataFrame([(1, d(20), True, False), (1, d(21), True, False), (2, d(2), True, False), (2, d(3), False, True)], "group_id long, ts timestamp, is_defect boolean, is_resolution boolean")
    arts = spark.createDataFrame([("a1", "payment", "critical", 90), ("a2", "map", "low", None)], "id string, module string, risk_tier string, risk_score int")
    blast = spark.createDataFrame([("payment", 9)], "module string, dependents long")
    bugs = I.bug_proposals(members, reports, arts, blast, now, "app")
    got = {r.ref_id: r for r in bugs.collect()}
    assert got["2"].suppressed and not got["1"].suppressed and got["1"].target_module == "payment" and got["1"].effort == "L" and got["1"].body == "- boom\n- again"
    gaps = spark.createDataFrame([("g1", None, "chart export", "save the chart"), ("g2", "g1", "export", ""), ("g3", None, "zzz", "")], "id string, merged_into string, label string, description string")
    asks = spark.createDataFrame([("g1", "u1", None, "1", d(25)), ("g2", "u2", None, "2", d(25)), ("g3", None, None, "3", d(25))], "feature_id string, author_id string, author_name string, source_id string, ts timestamp")
    modules = spark.createDataFrame([("app/stock", ["StockChart"]), ("lib", [])], "module string, features array<string>")
    g = {r.ref_id: r for r in I.gap_proposals(asks, gaps, modules, now, "app").collect()}
    assert set(g) == {"g1", "g3"} and g["g1"].target_module == "app/stock" and g["g1"].reason == "grounded" and g["g3"].placement == "new_module" and g["g3"].effort == "XL"
    feats = spark.createDataFrame([("pay", "Pay", "payment", None), ("map", "Map", "map", None)], "id string, label string, module string, merged_into string")
    wish = spark.createDataFrame([("pay", "u1", None, "1", d(25)), ("map", "u1", None, "2", d(25))], "feature_id string, author_id string, author_name string, source_id string, ts timestamp")
    enh = I.enhancement_proposals(wish, feats, bugs.withColumn("feature_id", F.when(F.col("ref_id") == "1", "pay").otherwise("map")), now, "app")
    assert {r.ref_id: r.body for r in enh.collect()} == {"pay": "related bug", "map": ""}
    top = I.ranked(bugs, I.gap_proposals(asks, gaps, modules, now, "app"), enh)
    p = [r.priority for r in top.collect()]
    assert p == sorted(p, reverse=True) and len(p) == 5
    seen = I.with_decisions(top, spark.createDataFrame([("app", "bug_fix", "1", "approved")], "repo string, kind string, ref_id string, decision string"), F.lit("2026-02-01").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))
    assert {(r.ref_id, r.decision) for r in seen.collect() if r.kind == "bug_fix"} == {("1", "approved")} and all(r.stale for r in seen.collect())


def test_feature_graph_and_layout(spark):
    f = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "a"), ("d", "D", None)], "id string, label string, parent_id string")
    r = spark.createDataFrame([("b", "defective"), ("b", "grounded")], "feature_id string, state string")
    g = I.feature_graph(f, r)
    assert {x.id: (x.depth, x.n_reviews, x.n_defective) for x in g.collect()} == {"a": (0, 0, 0), "b": (1, 2, 1), "c": (1, 0, 0), "d": (0, 0, 0)}
    assert {x.id: (x.x, x.y) for x in I.tree_layout(g).collect()} == {"a": (0, 29.0), "b": (330, 0.0), "c": (330, 58.0), "d": (0, 116.0)}


def test_streams_equal_the_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("s", f"{i % 5}", datetime(2026, 5, 1 + i), i) for i in range(12)]
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, "source string, source_id string, ingested_at timestamp, seq int").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("source string, source_id string, ingested_at timestamp, seq int").option("maxFilesPerTrigger", 1).parquet(src)
    store = Store(spark, str(tmp_path / "store"))
    upsert_stream(stream, store, "t", ["source", "source_id"], ["seq"], str(tmp_path / "c1")).awaitTermination()
    upsert_stream(stream, store, "t", ["source", "source_id"], ["seq"], str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.source_id, r.seq) for r in store.read("t").collect()) == [("0", 10), ("1", 11), ("2", 7), ("3", 8), ("4", 9)]
    for k, q in enumerate((unique_reviews(stream, "30 days"), windowed_counts(stream, "ingested_at", "source"))):
        out = str(tmp_path / f"out{k}")
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"c2{k}")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out0")).count() == 5
    assert {r.n for r in spark.read.parquet(str(tmp_path / "out1")).collect()} == {1}
