"""The client end to end: extraction, storage, queries, feedback, health."""

import pytest

from loomgraph import cli, tools
from loomgraph.api import Client, doctor
from loomgraph.sources.files import in_memory, read_tree
from loomgraph.store import GraphStore, graph_path

FILES = [
    ("a.ts", "// implements XSPEC-42\nexport function execute() { helper(1); missing(); }\n"),
    ("b.ts", "function helper(n) { return n; }\nclass Service { run() { this.execute(); } execute() { helper(2); } }\n"),
    ("c.py", "def lone():\n    return both()\n"),
    ("d.py", "def both():\n    pass\n"),
    ("e.py", "def both():\n    pass\n\ndef broken(:\n"),
]


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    c = Client(spark, str(tmp_path_factory.mktemp("g") / "x.graph"))
    c.counts = c.index_files(in_memory(spark, FILES), "r")
    docs = [("---\nid: SPEC-205\n---\n[[DEC-062]]", None, 0), ("# DEC-062 t\n[[SPEC-205]]", "DEC-062.md", 1), ("Supersedes [[DEC-062]]", "specs/DEC-069-x.md", 2), ("x", "README.md", 3)]
    c.doc_counts = c.index_documents(spark.createDataFrame(docs, "content string, fallback_id string, ordinal long"))
    return c


def test_counts(client):
    assert client.counts["unresolved"] == 1 and client.counts["partial"] == 1 and client.counts["total"] == 5
    assert client.doc_counts["specs"] == 1 and client.doc_counts["decisions"] == 2 and client.doc_counts["supersedes"] == 1
    assert client.doc_counts["docs_unresolved"] == 1


def test_calls(client):
    assert [r["id"] for r in client.callers("helper").collect()] == ["a.ts#execute", "b.ts#Service.execute"]
    assert {r["id"] for r in client.callers("helper", 2).collect()} == {"a.ts#execute", "b.ts#Service.execute", "b.ts#Service.run"}
    assert client.callers("nobody").collect() == []
    edges = {(r["src"], r["dst"]): r["confidence"] for r in client.graph.table("CALLS").collect()}
    assert edges[("a.ts#execute", "b.ts#helper")] == 0.5 and edges[("b.ts#Service.execute", "b.ts#helper")] == 0.8


def test_specs(client):
    found = client.implementers("xspec-42")
    assert found["origin"] == "annotated" and found["modules"] == [{"module": "a.ts", "functions": ["execute"]}]
    assert client.implementers("SPEC-999") == {"title": None, "origin": None, "modules": []}
    assert client.implemented_specs("./a.ts")["specs"] == ["XSPEC-42"]
    assert client.implemented_specs("zzz.ts") == {"module_found": False, "resolved_from": None, "ambiguous_matches": [], "specs": []}
    assert {(r["id"], r["via"]) for r in client.impact("SPEC-205").collect()} == {("DEC-062", "direct"), ("DEC-069", "supersedes")}
    assert client.impact("SPEC-1").collect() == []


def test_feedback_survives_reindex(spark, client):
    events = spark.createDataFrame([(k, "b.ts#helper", "test_fail") for k in range(3)] + [(9, "nobody", "test_fail")], "seq long, node_id string, kind string")
    trace = client.feedback(events).collect()
    assert [round(r["after"], 2) for r in sorted(trace, key=lambda r: r["seq"])] == [0.75, 0.5, 0.25]
    client.index_files(in_memory(spark, FILES), "r")
    assert client.graph.table("Function").where("id = 'b.ts#helper'").first()["confidence"] == 0.25
    with pytest.raises(ValueError, match="valid labels"):
        client.feedback(events, "Module")


def test_health(spark, client):
    assert [b["path"] for b in client.blindspots()] == ["e.py"]
    told = client.index_health(spark.createDataFrame([("c.py",)], "file string"))
    assert told["partial"] == 1 and told["possibly_incomplete"]
    assert not client.index_health(spark.createDataFrame([("deep/c.py",)], "file string"))["possibly_incomplete"]
    assert client.signatures()["signatures"][0]["files"] == 1


def test_ranking_and_query(client):
    assert client.god_nodes(3).count() == 3
    assert client.related("nobody").collect() == []
    assert "b.ts#helper" in {r["id"] for r in client.related("a.ts#execute", 1).collect()}
    assert client.query("select count(*) n from Function where file = :f", f="b.ts").first()["n"] == 3
    assert client.communities(2, 3).count() == client.graph.table("Function").count()


def test_service(client):
    assert cli.answer(client, "GET", "/health", {})[0] == 200
    assert cli.answer(client, "POST", "/graph/call-chain", {})[0] == 400
    status, body = cli.answer(client, "POST", "/graph/call-chain", {"symbol": "helper", "direction": "callers"})
    assert status == 200 and len(body["nodes"]) == 2
    assert cli.answer(client, "POST", "/graph/ingest", {"nodeId": "nobody", "type": "test_fail"})[0] == 404
    assert cli.answer(client, "POST", "/nowhere", {})[0] == 404


def test_store_rules(spark, client, tmp_path):
    reader = GraphStore.open(spark, client.graph.path, read_only=True)
    with pytest.raises(PermissionError):
        reader.clear()
    with pytest.raises(FileNotFoundError, match="index a folder"):
        GraphStore.open(spark, str(tmp_path / "none"), read_only=True)
    before = reader.table("Function").count()
    client.graph.write({"Module": client.graph.table("Module")})
    assert reader.table("Function").count() == before  # the version it opened
    assert graph_path("/r", explicit="/x", environment={}) == "/x"
    assert graph_path("/r", graph="a b", environment={}) == "/r/.loomgraph/a-b.graph"
    with pytest.raises(ValueError, match="organisation"):
        graph_path("/r", isolation="project", environment={})


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.ts").write_text("function f() {}")
    (tmp_path / "src" / "a.d.ts").write_text("declare function f(): void")
    (tmp_path / "node_modules" / "b.ts").write_text("x")
    assert [(r["path"], r["language"]) for r in read_tree(spark, str(tmp_path)).collect()] == [("src/a.ts", "typescript")]
    assert len(doctor()["languages"]) == 13


def test_tools(client):
    ask = lambda m, **p: tools.handle(client, {"id": 1, "method": m, "params": p})
    assert len(ask("tools/list")["result"]["tools"]) == 11
    told = ask("tools/call", name="call_chain", arguments={"symbol": "helper", "direction": "callers"})["result"]
    assert not told["isError"] and "a.ts#execute" in told["content"][0]["text"]
    assert ask("tools/call", name="ingest_feedback", arguments={"nodeId": "nobody", "type": "test_fail"})["result"]["isError"]
    assert ask("tools/call", name="nothing")["result"]["isError"] and ask("nothing")["error"]["code"] == -32601
    assert tools.handle(client, {"method": "notifications/initialized"}) is None
