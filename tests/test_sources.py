from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, frameworks, java, store
from tessera.streaming import sync, watch


def chain(n):
    out = {"Entry.java": f"class Entry {{ void run() {{ new Mod{n - 1}().fn{n - 1}(0); }} }}"}
    for i in range(n):
        out[f"Mod{i}.java"] = f"class Mod{i}" + (f" extends Mod{i - 1}" if i else "") + f" {{\n  int fn{i}(int x) {{ return " + (f"fn{i - 1}(x) + 1" if i else "x") + "; }\n}\n"
    return out


def test_tree_to_graph(spark, tmp_path):
    for name, text in chain(6).items():
        (tmp_path / name).write_text(text)
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "Left.java").write_text("class Left {}")
    (tmp_path / "note.txt").write_text("no source")
    (tmp_path / "Broken.java").write_text("class Broken { void f( {")
    f = files.source_files(spark, str(tmp_path))
    assert sorted(r.path for r in f.collect()) == sorted([*chain(6), "Broken.java"]) and files.is_java_project(f)
    x = java.extracted(f).cache()
    assert [r.path for r in x.where("errors IS NOT NULL").collect()] == ["Broken.java"]
    nodes, edges = java.graph_of(x)
    names = {r.id: r.qualified_name for r in nodes.collect()}
    got = {(names[r.source], names[r.target], r.kind) for r in edges.collect()}
    assert ("Mod3", "Mod2", "extends") in got and ("Mod3.fn3", "Mod2.fn2", "calls") in got and ("Entry.run", "Mod5", "instantiates") in got and ("Entry.run", "Mod5.fn5", "calls") in got
    assert x.unpersist() is not None


def test_framework_declarations(spark):
    rows = [
        ("C.java", 'import org.springframework.x; class C { @GetMapping("/a") void a(){}\n @RequestMapping(value = "/b") void b(){} @Value("${k.v:1}") String s; @Autowired private ApiClient api;\n void c(){ api.find(1); } }'),
        ("Api.java", '@FeignClient(name="x", path="/v1")\ninterface ApiClient {\n @PostMapping("/p")\n void find(int i); }'),
        ("D.java", "@DubboService\npublic class D implements a.Other {\n public D(){}\n public void go(){}\n public int hashCode(){ return 1; } }"),
        ("E.java", "class E { @DubboReference private OtherService other;\n void run(){ other.go(); } }"),
    ]
    f = spark.createDataFrame(rows, "path string, text string")
    assert frameworks.detected(f) == ["spring", "openfeign", "dubbo"] and frameworks.detected(f.where("path = 'none'")) == []
    assert frameworks.detected(spark.createDataFrame([("pom.xml", "<x>org.apache.dubbo</x>")], "path string, text string")) == ["dubbo"]
    assert frameworks.applicable("Kotlin") == ["spring", "openfeign", "dubbo"] and frameworks.applicable("python") == []
    assert sorted((r.name, r.start_line) for r in frameworks.spring_routes(f).collect()) == [("Get /a", 1), ("Post /p", 3), ("Request /b", 2)]
    assert [r.name for r in frameworks.spring_values(f).collect()] == ["${k.v}"]
    assert [(r.id, r.name, r.decorators) for r in frameworks.feign_routes(f).collect()] == [("ROUTE:ApiClient:Post /v1/p", "FEIGN Post /v1/p", ['@FeignClient(name="x")'])]
    assert [(r.name, r.start_line) for r in frameworks.provider_routes(f).collect()] == [("DUBBO Other.go", 4)]
    nodes, _, _ = java.merged(java.extracted(f))
    made, uses = frameworks.extracted(f, nodes)
    names = {r.id: r.name for r in nodes.collect()}
    # a body is the lines from a method's first on, so what follows it shortly counts, too
    assert {(names[r.source], r.target, r.provenance) for r in uses.collect()} == {(x, "ROUTE:ApiClient:Post /v1/p", "framework:openfeign") for x in "abc"}
    assert made.where("kind = 'route'").count() == 5 and frameworks.extracted(f, nodes, []) == (None, None)


def test_conventions_and_super_calls(spark):
    rows = [("a/service/UserService.java", "package a; class UserService { void go(){} }"), ("b/UserService.java", "package b; class UserService { void go(){} }"), ("c/X.java", "package c; class X extends Base { void go(){ super.go(); } }"), ("c/Base.java", "package c; class Base { void go(){} }")]
    n, e, r = java.merged(java.extracted(spark.createDataFrame(rows, "path string, text string")))
    refs = spark.createDataFrame([("r", "UserService")], "ref_id string, reference_name string")
    hit = frameworks.by_convention(refs, n).collect()
    paths = {x.id: (x.file_path, x.kind, x.name) for x in n.collect()}
    assert [paths[x.target] for x in hit] == [("a/service/UserService.java", "class", "UserService")]
    calls = java.resolved_edges(n, e, r).where("kind = 'calls'").collect()
    assert [(paths[x.source][0], paths[x.target][0]) for x in calls] == [("c/X.java", "c/Base.java")]


def test_names_resolve_to_the_nearest(spark):
    from tessera.operators import analytics, resolve

    rows = [(f"n{i}", "class", "Thing", f"q{i}.Thing", p, x) for i, (p, x) in enumerate([("a/b/c/T.java", False), ("a/b/d/T.java", True), ("a/x/T.java", True), ("T.java", True), ("a/b/c/U.java", True), ("z/T.java", False)])]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string, is_exported boolean")
    asked = ["a/b/c/R.java", "a/b/R.java", "a/x/y/z/R.java", "R.java", "z/T.java", "k/R.java", "a/b/d/T.java"]
    refs = spark.createDataFrame([(str(i), "Thing", p) for i, p in enumerate(asked)], "ref_id string, reference_name string, file_path string")
    got = {r.ref_id: (r.target, r.level) for r in resolve.by_name(refs, nodes).collect()}
    pairs = refs.crossJoin(nodes.select(F.col("id").alias("target"), F.col("file_path").alias("p"), "is_exported"))
    scored = pairs.select("ref_id", "target", analytics.proximity(F.col("file_path"), F.col("p"), F.col("is_exported")).alias("near")).collect()
    for i in range(len(asked)):
        best = min((-r.near, r.target) for r in scored if r.ref_id == str(i))
        assert got[str(i)] == (best[1], 1)


def test_changes_add_up_and_settle(spark):
    s = "path string, content_hash string, size long, modified_at long"
    old = spark.createDataFrame([("same", "h", 1, 1), ("touch", "h", 1, 1), ("edit", "h", 1, 1), ("gone", "h", 1, 1)], s)
    new = spark.createDataFrame([("same", "h", 1, 1), ("touch", "h", 1, 2), ("edit", "i", 2, 2), ("new", "h", 1, 1)], s)
    got = {r.path: r.change for r in sync.changes(old, new).collect()}
    assert got == {"same": "unchanged", "touch": "touched", "edit": "modified", "gone": "removed", "new": "added"}
    after = sync.synced(old, new)
    assert {r.change for r in sync.changes(after, new).collect()} == {"unchanged"}
    assert {r.change for r in sync.changes(after, new, force=True).collect()} == {"modified"}


def test_store_versions(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/g")
    assert not st.exists() and st.schema_version() is None
    st.init()
    assert st.schema_version() == 1 and st.table("nodes").count() == 0 and st.number() == 1
    df = spark.createDataFrame([("a", 1)], "id string, v int")
    st.commit({"nodes": df, "edges": df})
    st.commit({"nodes": store.upserted(st.table("nodes"), spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 9, 1)], "id string, v int, seq int"), "id")})
    assert sorted(tuple(r) for r in st.table("nodes").collect()) == [("a", 3), ("b", 9)] and st.table("edges").count() == 1
    assert st.table("nodes", 2).count() == 1  # what readers of an earlier commit see stays
    with pytest.raises(store.Conflict):
        st.commit({"edges": df.limit(0)}, 2)
    assert st.table("edges").count() == 1 and len(list((tmp_path / "g" / "edges").iterdir())) == 2
    with pytest.raises(KeyError):
        st.table("none")
    with st.lock(), pytest.raises(store.Conflict), st.lock():
        pass
    with st.lock():
        pass


def test_references_are_numbered_on(spark):
    s = "id long, from_node_id string"
    first = store.appended_refs(spark.createDataFrame([], s), spark.createDataFrame([(0, f"n{i:03d}") for i in range(50)], s).repartition(5), ["from_node_id"])
    both = store.appended_refs(first, spark.createDataFrame([(0, "a"), (0, "b")], s), ["from_node_id"])
    assert sorted(r.id for r in both.collect()) == list(range(1, 53)) and {r.from_node_id: r.id for r in both.collect()}["b"] == 52
    assert store.appended_refs(first, first.limit(0), ["from_node_id"]).count() == 50


def test_watched_folder_and_retries(spark, tmp_path):
    events = spark.range(20).select((F.col("id") % 3).cast("string").alias("path"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    seen, fails = [], [1, 1]

    def apply(batch, number):
        if fails:
            fails.pop()
            raise OSError("locked")
        seen.append((number, watch.bursts(batch, silence="10 seconds").count()))

    kept = watch.StoredNumber(spark, f"file://{tmp_path}/done")
    r = watch.Retrying(apply, sleep=lambda s: None, done=kept)
    r(spark.read.parquet(str(tmp_path / "in")), 0)
    r(spark.read.parquet(str(tmp_path / "in")), 0)
    assert seen == [(0, 3)]
    watch.Retrying(apply, done=kept)(spark.read.parquet(str(tmp_path / "in")), 0)  # after a restart
    assert seen == [(0, 3)] and kept.read() == 0
    q = watch.watch(spark, str(tmp_path / "in"), "path string, ts timestamp", apply, str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert seen[1:] == [(0, 3)] and watch.waits(1) == 2.0 and watch.waits(9) == 30.0


def test_watch_policy_and_gate():
    env = {"WSL_DISTRO_NAME": "x"}
    assert watch.disabled_reason("/home/a", env) is None and "mounted" in watch.disabled_reason("/mnt/c/a", env)
    assert watch.disabled_reason("/mnt/c/a", {**env, watch.FORCE_WATCH: "1"}) is None and watch.NO_WATCH in watch.disabled_reason("/a", {watch.NO_WATCH: "1", watch.FORCE_WATCH: "1"})
    assert watch.Gate(lambda: None).wait()
    broken = watch.Gate(lambda: 1 / 0)
    assert broken.wait() and isinstance(broken.error, ZeroDivisionError)


def test_file_events(spark, tmp_path):
    (tmp_path / "p" / "target").mkdir(parents=True)
    for name in ("A.java", "b.txt", "target/C.java"):
        (tmp_path / "p" / name).write_text("x")
    out = []
    q = watch.file_events(spark, f"file://{tmp_path}/p").writeStream.foreachBatch(lambda b, n: out.extend(r.path for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert out == ["A.java"]
