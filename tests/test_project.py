"""A project from its files to an answer: index, sync, explore, command line, HTTP, git."""

from __future__ import annotations

import json
import subprocess
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from tessera import api, cli, web
from tessera.explore import clusters, skeleton
from tessera.operators import rank
from tessera.plans.graph import PropertyGraph
from tessera.streaming import git, sync
from tests.test_sources import chain


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def edges(store):
    names = {r.id: r.qualified_name for r in store.table("nodes").collect()}
    return {(names[r.source], names[r.target], r.kind) for r in store.table("edges").collect()}


@pytest.fixture(scope="module")
def project(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("project")
    write(root, chain(6) | {"Broken.java": "class Broken { void f( {", "web/x.ts": "export class X { m() { return 1; } }", "target/T.java": "class T {}", "note.txt": "-"})
    store = sync.init(spark, f"file://{root}/.tessera")
    return root, store, sync.sync(store, f"file://{root}")


def test_sync_follows_the_files(spark, project, tmp_path):
    root, store, first = project
    assert (first.files_checked, first.files_added, first.files_modified, first.files_removed) == (9, 9, 0, 0) and first.nodes_updated > 20
    assert {r.path for r in store.table("files").where("errors IS NOT NULL").collect()} == {"Broken.java"}
    assert ("Mod3.fn3", "Mod2.fn2", "calls") in edges(store) and store.schema_version() == 1
    again = sync.sync(store, f"file://{root}")
    assert again.files_changed == 0 and again.commit == first.commit  # nothing to do
    before = edges(store)
    write(root, {"Consumer.java": "class Consumer { void use() { new Mod5().fn5(1); } }", "Mod0.java": "class Mod0 {\n  int fn0(int x) { return newHelper(x); }\n  int newHelper(int x) { return x; }\n}\n"})
    (root / "Mod3.java").unlink()
    third = sync.sync(store, f"file://{root}")
    assert (third.files_added, third.files_modified, third.files_removed) == (1, 1, 1)
    after = edges(store)
    assert ("Consumer.use", "Mod5.fn5", "calls") in after and ("Mod0.fn0", "Mod0.newHelper", "calls") in after
    assert not any("Mod3" in a or "Mod3" in b for a, b, _ in after) and {r.path for r in store.table("files").collect()} == {"Consumer.java", "Entry.java", "Broken.java", "web/x.ts", *(f"Mod{i}.java" for i in (0, 1, 2, 4, 5))}
    # an unchanged file's edge to a symbol that was made anew is there again
    assert ("Mod1.fn1", "Mod0.fn0", "calls") in before and ("Mod1.fn1", "Mod0.fn0", "calls") in after
    write(root, chain(6))
    (root / "Consumer.java").unlink()
    sync.sync(store, f"file://{root}")
    assert edges(store) == before
    forced = sync.sync(store, f"file://{root}", force=True)
    assert forced.files_modified == forced.files_checked and edges(store) == before


def test_explore_shows_source(spark, project):
    root, store, _ = project
    e = cli.engine(spark, f"file://{root}", store)
    text = e.explained("Mod2 fn3")
    assert "**Exploration: Mod2 fn3**" in text and "int fn3(int x) { return fn2(x) + 1; }" in text and "**Mod2.java**" in text and "Blast radius" in text
    assert e.explained("zzzzqqq") .startswith("No relevant code")
    shown = api.answer(e, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "explore", "arguments": {"query": "fn1"}}})
    assert "fn1" in shown["result"]["content"][0]["text"]
    drawn = api.answer(e, {"jsonrpc": "2.0", "id": 2, "method": "graph/view", "params": {"symbol": "Mod2"}})["result"]
    assert {n["name"] for n in drawn["nodes"]} >= {"Mod2", "fn2"} and drawn["nodes"][0]["color"].startswith("#")


def test_parts_of_files():
    class N:
        def __init__(self, i, kind, name, a, b):
            self.id, self.kind, self.name, self.start_line, self.end_line = i, kind, name, a, b

    lines = [f"line {k}" for k in range(1, 101)]
    lines[9], lines[39] = "void one() {", "void two() {"
    nodes = [N("c", "class", "C", 1, 100), N("m", "method", "one", 10, 14), N("n", "method", "two", 38, 44), N("x", "method", "x", 42, 43)]
    b = rank.BUDGETS[0][1]
    assert clusters(nodes, lines, lambda n: 10 if n.id == "m" else 3 if n.id == "n" else 1, b) == [(10, 14), (38, 44)]
    assert clusters(nodes, lines, lambda n: 1, b) == []
    s = skeleton(nodes, lines, {"m"}, set(), b).split("\n")
    assert s[0] == "1\tline 1" and s[1] == "10\tvoid one() {" and s[5] == "14\tline 14" and s[6] == "40\tvoid two() {"


def test_command_line(spark, tmp_path):
    write(tmp_path, chain(3))
    said = []
    run = lambda *a, **k: cli.main([*a, "-p", str(tmp_path)], spark, write=said.append, **k)
    assert run("init") == 0 and run("init") == 0 and "made an index" in said[0] and "already" in said[1]
    assert run("index", "--force") == 0 and "4 added" in said[-1]
    said.clear()
    assert run("sync", "-q") == 0 and said == []
    assert run("serve", "--mcp", lines=['{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"explore","arguments":{"query":"fn1"}}}']) == 0
    assert "fn1" in json.loads(said[0])["result"]["content"][0]["text"]
    assert cli.follow(spark, sync.init(spark, f"file://{tmp_path}/.tessera"), f"file://{tmp_path}", str(tmp_path), said.append, rounds=1) == 0


def test_http(spark):
    n = spark.createDataFrame([("a", "class", "A", "p.A", "A.java", 1, True, None), ("b", "method", "b", "p.A.b", "A.java", 2, True, None)], "id string, kind string, name string, qualified_name string, file_path string, start_line int, is_exported boolean, docstring string")
    e = spark.createDataFrame([("a", "b", "contains", 1)], "source string, target string, kind string, line int")
    s = web.server(api.Engine(PropertyGraph(n, e)), enabled=("search",))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    ask = lambda m: json.loads(urllib.request.urlopen(urllib.request.Request(base + web.ENDPOINT, json.dumps(m).encode(), method="POST")).read())
    assert b"graph/view" in urllib.request.urlopen(base + "/").read()
    assert {x["id"] for x in ask({"jsonrpc": "2.0", "id": 1, "method": "graph/view", "params": {"symbol": "A"}})["result"]["nodes"]} == {"a", "b"}
    assert ask({"jsonrpc": "2.0", "id": 2, "method": "tools/list"})["result"]["tools"][0]["inputSchema"]["required"] == ["query"]
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(base + "/none")
    s.shutdown()
    s.server_close()


def test_git(spark, tmp_path):
    run = lambda *a, at=tmp_path: subprocess.run(["git", "-C", str(at), "-c", "user.email=a@b", "-c", "user.name=a", *a], capture_output=True, check=True)
    assert git.install(tmp_path) == [] and not git.is_repository(tmp_path)
    run("init", "-q")
    write(tmp_path, {"A.java": "class A {}", ".git/hooks/post-merge": "#!/bin/sh\necho own\n"})
    assert git.install(tmp_path) == list(git.HOOKS) == git.install(tmp_path) and git.installed(tmp_path)
    assert (tmp_path / ".git/hooks/post-merge").read_text().count(git.BEGIN) == 1
    assert git.remove(tmp_path) == list(git.HOOKS) and not git.installed(tmp_path)
    assert (tmp_path / ".git/hooks/post-merge").read_text() == "#!/bin/sh\necho own\n" and not (tmp_path / ".git/hooks/post-commit").exists()
    run("add", "A.java")
    run("commit", "-qm", "one")
    write(tmp_path, {"A.java": "class A { }", "sub/B.java": "class B {}", "c.txt": "-"})
    tracked = spark.createDataFrame([], "path string, content_hash string")
    assert sorted(r.path for r in sync.changed_files(spark, f"file://{tmp_path}", tracked).collect()) == ["A.java", "sub/B.java"]
    assert git.mismatch(tmp_path, tmp_path) is None
    (tmp_path / "w").parent.mkdir(exist_ok=True)
    run("worktree", "add", "-q", str(tmp_path / "w"), "HEAD")
    assert str(tmp_path) in str(git.mismatch(tmp_path / "w", tmp_path))


def test_markdown_files(spark, tmp_path):
    df = spark.range(5).select(F.col("id"), F.lit("a|b").alias("x"))
    text = api.write_markdown(df, "Rows", tmp_path / "out" / "rows.md", 3).read_text()
    assert text.startswith("# Rows") and "a\\|b" in text and "The first 3 rows." in text
