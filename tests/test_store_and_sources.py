"""What is written and read back: trees, the manifest, versions under readers, backups, small commits."""

import os
import random

import pytest

from loomgraph import cli, schema
from loomgraph.api import Client
from loomgraph.operators import feedback, merge, ranges, rank
from loomgraph.sources import manifest
from loomgraph.sources.files import in_memory, read_documents, read_tree, unreached
from loomgraph.store import GraphStore, graph_path


def test_names_with_dots_and_underscores_are_read(spark, tmp_path):
    for name in ("__init__.py", "_priv.py", "mod.py", ".hidden.ts", ".config/a.ts", "_x/_y.go", "dist/no.py", ".git/no.py", "out/yes.py", "t.d.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    (tmp_path / "bad.py").write_bytes(b"a = '\xff'")
    (tmp_path / "link").symlink_to(tmp_path / "_x")
    (tmp_path / "dangling.py").symlink_to(tmp_path / "nowhere")
    (tmp_path / "same.py").symlink_to(tmp_path / "mod.py")
    got = {r["path"]: r["source"] for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"__init__.py", "_priv.py", "mod.py", ".hidden.ts", ".config/a.ts", "_x/_y.go", "out/yes.py", "bad.py", "same.py"}
    assert got["bad.py"] == "a = '�'" and unreached(str(tmp_path))["linked_folders"] == ["link"]
    assert read_tree(spark, str(tmp_path), (".none",)).count() == 0


def test_a_file_that_vanishes_is_left_out(spark, tmp_path):
    (tmp_path / "a.py").write_text("a")
    (tmp_path / "b.py").write_text("b")
    found = read_tree(spark, str(tmp_path))
    os.remove(tmp_path / "b.py")
    assert [r["path"] for r in found.collect()] == ["a.py"]


def test_documents_are_in_order_of_paths(spark, tmp_path):
    for name in ("b.md", "_a.md", "c/z.md", "a.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert [r["fallback_id"] for r in read_documents(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["_a.md", "a.md", "b.md", "c/z.md"]


@pytest.fixture()
def client(spark, tmp_path):
    return Client(spark, str(tmp_path / "x.graph"))


def test_runs_of_the_nameless_root_are_compared(spark, client):
    good, bad = in_memory(spark, [("a.py", "def a():\n    pass\n")]), in_memory(spark, [("a.py", "def a(:\n")])
    assert "healed" not in client.index_files(bad)
    assert client.index_files(good)["healed"] == 1
    assert client.index_files(bad)["regressed"] == 1
    client.index_files(in_memory(spark, [("z.py", "def z(:\n"), ("b.py", "def z(:\n")]), "other")
    assert client.signatures()["signatures"][0]["samples"] == ["a.py", "b.py", "z.py"]
    client.index_files(good, clean=True)
    assert client.blindspots() == []


def test_health_that_cannot_be_told_is_no_good_health(spark, client):
    files = spark.createDataFrame([("a.py",)], "file string")
    assert client.index_health(files) is None
    client.index_files(in_memory(spark, [("a.py", "def a(:\n"), ("b.ts", "function b() { b2(); }\nfunction b2() {}")]))
    assert client.index_health(files)["possibly_incomplete"]
    status, told = cli.answer(client, "POST", "/graph/call-chain", {"symbol": "b2"})
    assert status == 200 and told["nodes"] and told["indexHealth"]["failed"] + told["indexHealth"]["partial"] == 1
    with open(f"{client.manifest_path}/INDEX", "w") as f:
        f.write("{")
    assert "could not be parsed" in client.index_health(files)["unavailable"]
    assert manifest.read_or_none(spark, client.manifest_path) is None
    assert cli.answer(client, "POST", "/graph/call-chain", {"symbol": "b2"})[1]["indexHealth"]["unavailable"]
    client.index_files(in_memory(spark, [("a.py", "def a():\n    pass\n")]))
    assert client.index_health(files) is None


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "g")
    writer = GraphStore.open(spark, path)
    row = lambda i: spark.createDataFrame([(f"m{i}", f"m{i}")], "id string, path string")
    writer.write({"Module": row(0)})
    reader = GraphStore.open(spark, path, read_only=True)
    for i in range(1, 4):
        writer.write({"Module": row(i)})
    assert reader.table("Module").count() == 1 and reader.table("Spec").count() == 0
    assert writer.clean_up() == [] and reader.table("Module").count() == 1
    kept = writer.backup()
    writer.clear()
    with pytest.raises(FileExistsError):
        open(f"{path}/{kept}", "x")
    assert len(writer.clean_up(0)) == 4 and GraphStore.open(spark, path).table("Module").count() == 0
    writer.restore(kept)
    assert GraphStore.open(spark, path).table("Module").count() == 4
    with pytest.raises(ValueError, match="no backup"):
        writer.restore("../x")


def test_a_small_commit_writes_one_table(spark, client):
    client.index_files(in_memory(spark, [("a.ts", "function a() {}")]))
    before = dict(client.graph.tables)
    client.feedback(spark.createDataFrame([(0, "a.ts#a", "test_fail")], "seq long, node_id string, kind string"))
    assert {t for t in before if before[t] != client.graph.tables[t]} == {"Function"}


def test_migration_makes_a_backup(spark, tmp_path):
    store = GraphStore.open(spark, str(tmp_path / "g"))
    store.replace({"Class": spark.createDataFrame([("c", "c", "f")], "id string, name string, file string")})
    again = GraphStore.open(spark, str(tmp_path / "g"))
    assert again.table("Class").first()["provider"] == schema.DEFAULT_PROVIDER
    assert len([x for x in os.listdir(tmp_path / "g") if x.startswith("BACKUP-")]) == 1


def test_a_shared_graph_has_its_own_path():
    assert graph_path("/r", isolation="shared", environment={}, shared="/s/g.graph") == "/s/g.graph"
    with pytest.raises(ValueError, match="shared"):
        graph_path("/r", isolation="shared", environment={})


def test_edges_need_both_ends(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    stored = spark.createDataFrame([("a", "b", 1, 0.5, "tree-sitter")], schema.ddl("CALLS"))
    batch = spark.createDataFrame([(s, d, 7, 0.9, "scip", 0, ["call_count", "confidence", "provider"]) for s, d in (("a", "b"), ("a", "x"), ("x", "b"), ("b", "a"))], schema.ddl("CALLS") + ", ordinal int, present array<string>")
    got = {(r["src"], r["dst"]): r["call_count"] for r in merge.upsert_edges(stored, batch, ids("a", "b"), ids("a", "b")).collect()}
    assert got == {("a", "b"): 7, ("b", "a"): 7}


def test_feedback_over_many_pieces_is_the_plain_fold(spark):
    rng = random.Random(3)
    kinds = ["test_fail", "test_pass", "human_fix", "status_change", "unknown"]
    events = [(k, rng.choice(["hot", "hot", "hot", "cold", "none"]), rng.choice(kinds), rng.choice([None, 0.3, 2.0, -1.0])) for k in range(3000)]
    nodes = spark.createDataFrame([("hot", None), ("cold", 0.9), ("quiet", 0.2)], "id string, confidence double")
    df = spark.createDataFrame(events, "seq long, node_id string, kind string, weight double")
    delta = {r["seq"]: r["delta"] for r in feedback.signals(df).collect()}
    now, want = {"hot": 0.5, "cold": 0.9}, {}
    for seq, node, _, _ in events:
        if node in now:
            was = now[node]
            now[node] = max(feedback.LOW, min(feedback.HIGH, was + delta[seq]))
            want[node, seq] = was, now[node]
    got = {(r["node_id"], r["seq"]): (r["before"], r["after"]) for r in feedback.feedback_trace(nodes, df).collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))
    after = {r["id"]: r["confidence"] for r in feedback.apply_feedback(nodes, df).collect()}
    assert all(abs(after[k] - v) < 1e-9 for k, v in now.items()) and after["quiet"] == 0.2


def test_containment_is_brute_force(spark):
    rng = random.Random(4)
    scopes = [(rng.choice("fg"), s := rng.randrange(-50, 3000), s + rng.choice([0, 1, 2, 3, 7, 8, 60, 500, 2900]), k) for k in range(300)]
    sites = [(rng.choice("fgh"), s := rng.randrange(-60, 3100), s + rng.choice([0, 0, 1, 5, 40]), k) for k in range(300)]
    a = spark.createDataFrame(sites, "file string, start int, end int, site int")
    b = spark.createDataFrame(scopes, "file string, start int, end int, id int").withColumnRenamed("id", "ordinal").selectExpr("*", "ordinal as id")
    inside = {(k, n) for f, s, e, k in sites for g, x, y, n in scopes if f == g and x <= s and y >= e}
    got = ranges.around(a, b.selectExpr("file as f", "start as s", "end as e", "id as o")).select("site", "o").collect()
    assert {tuple(r) for r in got} == inside and len(got) == len(inside)
    best = {}
    for k, n in inside:
        best[k] = min(best.get(k, (9999, 9999)), (scopes[n][2] - scopes[n][1], n))
    found = {r["site"]: r["scope_id"] for r in ranges.smallest_containing(a, b, "left").collect()}
    assert found == {k: best[k][1] if k in best else None for *_, k in sites}


def test_communities_are_as_modular_as_the_best_partition(spark):
    """Four cliques in a ring: the communities are the cliques, and no move of a node raises the modularity."""
    edges = [(f"{c}{i}", f"{c}{j}") for c in "abcd" for i in range(5) for j in range(i)] + [("a0", "b0"), ("b1", "c1"), ("c2", "d2"), ("d3", "a3")]
    v = spark.createDataFrame([(f"{c}{i}",) for c in "abcd" for i in range(5)] + [("alone",)], "id string")
    got = {r["id"]: r["community"] for r in rank.communities(v, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"{c}{i}": f"{c}0" for c in "abcd" for i in range(5)} | {"alone": "alone"}

    def modularity(member):
        degree = {}
        for x, y in edges:
            degree[x], degree[y] = degree.get(x, 0) + 1, degree.get(y, 0) + 1
        m = len(edges)
        inside = sum(member[x] == member[y] for x, y in edges) / m
        return inside - sum((sum(k for n, k in degree.items() if member[n] == c) / (2 * m)) ** 2 for c in set(member.values()))

    best = modularity(got)
    assert all(modularity(got | {n: c}) <= best + 1e-12 for n in got for c in set(got.values()))


def test_titles_that_are_null_stay_null(spark):
    nodes = spark.createDataFrame([("Spec", "s", None), ("Function", "f", "F")], "label string, id string, display string")
    edges = spark.createDataFrame([("REL", "Function", "f", "Spec", "s")], "rel string, src_label string, src string, dst_label string, dst string")
    assert [r["display"] for r in rank.god_nodes(nodes, edges, 2).collect()] == [None, "F"]


def test_overloads_are_one_node(spark):
    definitions = spark.createDataFrame([("s1", "a.cs#f", "function"), ("s2", "a.cs#f", "function"), ("s3", None, "function"), ("s4", "a.cs#class:C", "class")], "symbol string, id string, kind string")
    scopes = spark.createDataFrame([("a.cs#f", "a.cs", "function", "f", 3), ("a.cs#f", "a.cs", "function", "f", 9), ("a.cs#class:C", "a.cs", "class", "C", 1), ("a.cs#g", "a.cs", "function", "g", 5)], "id string, file string, kind string, name string, start_line int")
    got = {r["id"]: (r["kind"], r["name"], r["start_line"]) for r in ranges.index_nodes(definitions, scopes).collect()}
    assert got == {"a.cs#f": ("function", "f", 3), "a.cs#class:C": ("class", "C", 1)}
