from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import text
from tessera.operators import analytics, lookup, traverse, walk
from tessera.plans.graph import PropertyGraph
from tessera.plans.lineage import shared_dir

NODES = [("m", "module"), ("a", "class"), ("b", "class"), ("a1", "method"), ("a2", "method"), ("b1", "method"), ("c", "class"), ("lone", "function")]
EDGES = [("m", "a", "contains"), ("m", "b", "contains"), ("a", "a1", "contains"), ("a", "a2", "contains"), ("b", "b1", "contains"), ("a1", "b1", "calls"), ("a1", "b1", "references"), ("b1", "a2", "calls"), ("a2", "a1", "calls"), ("b", "a", "extends"), ("c", "b", "extends"), ("a1", "c", "instantiates")]


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame([(i, k, i.upper(), f"pkg.{i}", f"src/{i[0]}.java", j + 1, i in ("a", "m"), None) for j, (i, k) in enumerate(NODES)], "id string, kind string, name string, qualified_name string, file_path string, start_line int, is_exported boolean, docstring string")
    e = spark.createDataFrame([(*x, 1) for x in EDGES], "source string, target string, kind string, line int")
    return PropertyGraph(n, e)


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_bfs_tree_has_one_edge_less_than_nodes(g):
    t = traverse.bfs(g, "m", direction="both").collect()
    assert len(t) == 7 and sum(r.parent is not None for r in t) == 6
    assert pairs(traverse.bfs(g, "m", 1), "id", "level") == [("a", 1), ("b", 1), ("m", 0)]
    assert traverse.bfs(g, "none").collect() == [] and traverse.bfs(g, "m", limit=2).count() == 2
    assert pairs(traverse.bfs(g, "m", node_kinds=("module", "class")), "id") == [("a",), ("b",), ("m",)]


def test_callers_and_callees_mirror_each_other(g):
    assert pairs(traverse.callers(g, "b1"), "id", "kind") == [("a1", "calls"), ("a1", "references")]
    assert pairs(traverse.callees(g, "a1"), "id", "kind") == [("b1", "calls"), ("b1", "references"), ("c", "instantiates")]
    assert pairs(traverse.callers(g, "b1", 3), "id", "level") == [("a1", 1), ("a1", 1), ("a2", 2), ("b1", 3)]


def test_impact_takes_what_containers_hold(g):
    assert pairs(traverse.impact(g, "a", 1), "id", "level") == [("a", 0), ("a1", 0), ("a2", 0), ("b", 1)]
    assert pairs(traverse.impact(g, "a", 2), "id", "level") == [("a", 0), ("a1", 0), ("a2", 0), ("b", 1), ("b1", 1), ("c", 2)]


def test_impact_opens_a_container_within_a_container_that_is_hit_late(spark):
    kinds = {"f": "function", "x": "class", "y": "class", "z": "method", "w": "class", "v": "method"}
    n = spark.createDataFrame([(i, k, i, i, "p.java", 1, True, None) for i, k in kinds.items()], "id string, kind string, name string, qualified_name string, file_path string, start_line int, is_exported boolean, docstring string")
    e = spark.createDataFrame([("x", "f", "calls", 1), ("x", "y", "contains", 1), ("y", "z", "contains", 1), ("y", "x", "references", 1), ("y", "w", "contains", 1), ("w", "x", "contains", 1), ("w", "v", "contains", 1)], "source string, target string, kind string, line int")
    assert pairs(traverse.impact(PropertyGraph(n, e), "f", 2), "id", "level") == [("f", 0), ("v", 1), ("w", 1), ("x", 1), ("y", 1), ("z", 1)]


def test_depths_and_limits(g, spark):
    assert pairs(analytics.depths(g.nodes, g.edges), "id", "depth") == [("a", 1), ("a1", 2), ("a2", 2), ("b", 1), ("b1", 2), ("c", 0), ("lone", 0), ("m", 0)]
    loop = spark.createDataFrame([("a", "b", "contains", 1), ("b", "a", "contains", 1), ("m", "c", "contains", 1)], "source string, target string, kind string, line int")
    assert {r.id: r.depth for r in analytics.depths(g.nodes, loop).collect() if r.id in "abc"} == {"a": None, "b": None, "c": 1}
    assert pairs(traverse.bfs(g, "m", limit=3, include_start=False), "id") == [("a",), ("a1",), ("b",)]
    assert pairs(traverse.dfs(g, "m", 1), "id", "level") == [("a", 1), ("b", 1), ("m", 0)]


def test_hierarchy_ancestors_path(g):
    assert pairs(traverse.type_ancestors(g, "c"), "id") == [("a",), ("b",)] and pairs(traverse.type_descendants(g, "a"), "id") == [("b",), ("c",)]
    assert pairs(traverse.ancestors(g, "a1"), "id", "level") == [("a", 1), ("m", 2)]
    assert traverse.path(g, "m", "c") == [("a", "contains"), ("a1", "contains"), ("c", "instantiates")]
    assert traverse.path(g, "m", "m") == [] and traverse.path(g, "m", "lone") is None
    assert [r.hops for r in traverse.distance(g, "m", "c").collect()] == [3]


def test_cycles(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "g"), ("e", "h")], "from_file string, to_file string")
    assert pairs(analytics.cyclic_files(d), "file", "cycle") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert analytics.cyclic_files(d.where("from_file = 'f'")).count() == 0


def test_random_walk_keeps_its_mass_and_agrees_on_the_driver(g):
    ids, seeds = g.nodes.select("id"), g.nodes.where("id = 'a1'").select("id")
    far = {r.id: r.score for r in analytics.random_walk(g.edges, ids, seeds).collect()}
    kinds = set(analytics.RANK_KINDS)
    near = analytics.random_walk_small([i for i, _ in NODES], [(a, b) for a, b, k in EDGES if k in kinds], ["a1"])
    assert sum(far.values()) == pytest.approx(1) and far == pytest.approx(near)


def test_dangling_edges_are_set_apart(g):
    e = g.edges.union(g.edges.limit(1).select(F.lit("m"), F.lit("nowhere"), F.lit("calls"), F.lit(1))).union(g.edges.limit(1).select(F.lit("m"), F.lit("a"), F.lit("odd"), F.lit(1)))
    good, bad = PropertyGraph(g.nodes, e).quarantined()
    assert good.edges.count() == len(EDGES) and sorted(r.reason for r in bad.collect()) == ["kind", "target"]


def test_stored_graph_comes_back(g, spark, tmp_path):
    g.save(str(tmp_path))
    assert pairs(PropertyGraph.stored(spark, str(tmp_path)).edges, "source", "target", "kind") == sorted(EDGES)


def test_search_takes_wildcards_as_they_stand(g):
    assert lookup.search(g.nodes, "%").count() == 0 and lookup.search(g.nodes, "PKG.A").count() == 3
    assert pairs(lookup.by_glob(g.nodes, "pkg.?"), "id") == [("a",), ("b",), ("c",), ("m",)]


def test_query_terms():
    assert text.symbols("find UserService.java (get_user), a x.y") == ["find", "UserService", "get_user", "x.y"]
    assert text.stems("running") == ["runn", "runne", "run"] and "entry" in text.stems("entries") and text.stems("class") == []
    assert text.terms("where is UserService called") == ["userservice", "user", "service"]
    assert text.is_distinctive("getUser") and not text.is_distinctive("user")


def test_tools_and_guards(g):
    e = api.Engine(g)
    assert pairs(e.callers("B1"), "id") == [("a1",), ("a1",)] and e.status().count() > 5
    assert e.explore("pkg.a1 pkg.b1 calls").count() > 0
    for call in (lambda: e.search("x" * 10_001), lambda: e.callers("a", "p" * 4_097), lambda: e.callees(""), lambda: e.node()):
        with pytest.raises(ValueError):
            call()
    out = []
    api.serve(e, ['{"jsonrpc":"2.0","id":1,"method":"tools/list"}', "nonsense", '{"jsonrpc":"2.0","id":2,"method":"tools/call","params":{"name":"search","arguments":{"query":"A1"}}}', '{"jsonrpc":"2.0","method":"ping"}'], out.append, ("search",))
    assert '"search"' in out[0] and "inputSchema" in out[0] and "-32700" in out[1] and "pkg.a1" in out[2] and len(out) == 3
    assert "| kind |" in api.markdown(e.status().select("kind"), "Status")


def test_a_small_item_after_a_thousand_larger_ones_still_fits(spark):
    from tessera.operators import render

    rows = [("a", 0, 50)] + [("a", k, 20) for k in range(1, 1_500)] + [("a", 1_500, 10), ("a", 1_501, 1), ("b", 1, 99), ("b", 2, 1), ("c", 1, 60), ("c", 2, 70)]
    got = render.within_budget(spark.createDataFrame(rows, "file_path string, id long, size long").repartition(4), "file_path", ["id"], "size", 60)
    assert sorted((r.file_path, r.id, r["rank"]) for r in got.collect()) == [("a", 0, 1), ("a", 1_500, 1_501), ("b", 1, 1), ("c", 1, 1)]


def test_without_a_limit_a_traversal_is_whole(spark):
    n = spark.range(100_500).select(F.format_string("n%06d", "id").alias("id"), F.lit("class").alias("kind"))
    e = n.where("id <> 'n000000'").select(F.lit("n000000").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit(1).alias("line"))
    wide = PropertyGraph(n, e)
    assert traverse.bfs(wide, "n000000", limit=None).count() == traverse.dfs(wide, "n000000", 2, None).count() == 100_500
    assert traverse.bfs(wide, "n000000", 1, None, include_start=False).count() == 100_499
    assert traverse.bfs(wide, "n000000", limit=0).count() == 1_000


@pytest.mark.parametrize("name", ["g1_bfs", "g1_bfs_kinds", "g2_dfs"])
def test_traversal_queries_have_no_limit_as_their_sql_has_none(spark, monkeypatch, name):
    from tessera import queries

    n = spark.range(100_500).select(F.format_string("n%06d", "id").alias("id"), F.lit("class").alias("kind")).union(spark.createDataFrame([("module:2", "module"), ("nation:2", "class")]))
    e = n.where("kind = 'class'").select(F.when(F.col("id") == "nation:2", "module:2").otherwise("nation:2").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit(1).alias("line"))
    monkeypatch.setattr(PropertyGraph, "kept", classmethod(lambda cls, *a: cls(n, e)))
    assert queries.QUERIES[name](spark, "").count() == (100_502 if name == "g1_bfs_kinds" else 100_501)


def test_deleted_files_leave_no_edge_that_dangles(spark, monkeypatch):
    from tessera import queries
    from tessera.sources import store

    n = spark.createDataFrame([("a", "a.java"), ("b", "b.java"), ("c", "sales/orders/2-HIGH.java")], "id string, file_path string")
    e = spark.createDataFrame([("a", "b", "calls", 1), ("a", "c", "calls", 1), ("b", "gone", "imports", 1), ("gone", "a", "imports", 1)], "source string, target string, kind string, line int")
    kept, left = store.deleted_files(n, e, n.where("id = 'c'").select(F.col("file_path").alias("path")))
    assert pairs(kept, "id") == [("a",), ("b",)] and pairs(left, "source", "target") == [("a", "b")]
    monkeypatch.setattr(PropertyGraph, "kept", classmethod(lambda cls, *a: cls(n, e)))
    assert pairs(queries.QUERIES["k5_deleted_files"](spark, ""), "kind", "n") == [("calls", 1)]


def test_edges_are_checked_before_they_are_added(g, spark, monkeypatch):
    from tessera import queries

    e = spark.createDataFrame([(*x, 1) for x in [*EDGES, ("b", "nowhere", "imports")]], "source string, target string, kind string, line int")
    monkeypatch.setattr(PropertyGraph, "kept", classmethod(lambda cls, *a: cls(g.nodes, e)))
    got = dict(pairs(queries.QUERIES["j8_sound_edges"](spark, ""), "kind", "n"))
    assert got["imports"] == 1 and got["extends"] == 2 and sum(got.values()) == len(EDGES) + 1


def test_resolution_broadcasts_nothing_by_its_compressed_size(spark):
    from tessera.operators import resolve

    n = spark.createDataFrame([("t", "class", "A", "p.A", "p/A.java", True)], "id string, kind string, name string, qualified_name string, file_path string, is_exported boolean")
    r = spark.createDataFrame([("r", "A", "p/B.java")], "ref_id string, reference_name string, file_path string")
    for f in (resolve.by_name, resolve.by_import):
        found = f(r, n)
        found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert pairs(resolve.by_name(r, n), "ref_id", "target") == [("r", "t")]


WALKED = [(f"n{i}", f"n{i * i % 211}") for i in range(400)] + [(f"n{i}", f"n{i // 2}") for i in range(300)] * 2 + [("n7", "n7"), ("n8", "nowhere"), ("nowhere", "n9")]


@pytest.fixture(scope="module")
def walked(spark):
    names = [f"n{i}" for i in range(420)]
    ids = spark.createDataFrame([(i,) for i in [*names, *names[:5]]], "id string")
    return names, ids, spark.createDataFrame([(*x, "calls") for x in WALKED], "source string, target string, kind string")


@pytest.mark.parametrize("seeds", [["n3", "n7", "n3", "nowhere"], ["n410"], ["nowhere"], []])
def test_random_walk_is_the_same_in_many_blocks_and_files(spark, walked, monkeypatch, seeds):
    names, ids, edges = walked
    for what, n in (("BLOCK_NODES", 50), ("CHUNK", 64), ("FILE_STEPS", 100)):
        monkeypatch.setattr(walk, what, n)
    starts = spark.createDataFrame([(i,) for i in seeds], "id string")
    far = [(r.id, r.score) for r in analytics.random_walk(edges, ids, starts).collect()]
    assert len(far) == len(names) and dict(far) == pytest.approx(analytics.random_walk_small(names, WALKED, seeds))
    assert {r.id: r.score for r in analytics.random_walk(edges, ids, starts, 0).collect()} == pytest.approx(analytics.random_walk_small(names, WALKED, seeds, 0))
    assert not list(Path(shared_dir(spark).removeprefix("file://")).glob("walk_*"))


def test_random_walk_tells_nodes_of_one_hash_apart(spark, walked, monkeypatch):
    names, ids, edges = walked
    first = walk.hashed
    monkeypatch.setattr(walk, "hashed", lambda seed, c: first(seed, c) if seed else F.length(c).cast("long"))
    far = {r.id: r.score for r in analytics.random_walk(edges, ids, ids.where("id = 'n3'")).collect()}
    assert far == pytest.approx(analytics.random_walk_small(names, WALKED, ["n3"]))


def test_random_walk_of_more_nodes_than_are_packed_and_of_none(spark, walked, monkeypatch):
    names, ids, edges = walked
    assert analytics.random_walk(edges, ids.limit(0), ids).collect() == []
    assert {r.score for r in analytics.random_walk(edges.limit(0), ids, ids.where("id = 'n3'")).collect()} == {0.0, 1.0}
    monkeypatch.setattr(walk, "PACKED_NODES", 100)
    far = {r.id: r.score for r in analytics.random_walk(edges, ids, ids.where("id = 'n3'"), 3).collect()}
    assert far == pytest.approx(analytics.random_walk_small(names, WALKED, ["n3"], 3))


def test_random_walk_exchanges_its_steps_once(spark):
    """it exchanged all weighted steps in each round, which filled the disk."""
    n = 30_000
    ids = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"))
    edges = spark.range(4 * n).select(F.concat(F.lit("n"), F.col("id") % n).alias("source"), F.concat(F.lit("n"), F.col("id") * 7919 % n + F.col("id") % 5).alias("target"), F.lit("calls").alias("kind"))
    last = max((s.stageId() for s in _stages(spark)), default=-1)
    analytics.random_walk(edges, ids, ids.where("id = 'n3'")).count()
    written = sum(s.shuffleWriteBytes() for s in _stages(spark) if s.stageId() > last)
    assert 0 < written < 10 * 8 * n  # of each of the steps in both directions


def _stages(spark):
    gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]
