"""Traversals of the graph, single- or multi-source, as breadth-first fixpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.subgraph import in_same_files
from tessera.plans.fixpoint import first_of, levels, oriented, tree, tree_levels, union_all
from tessera.plans.graph import PropertyGraph
from tessera.plans.lineage import cut
from tessera.plans.schema import CALL_KINDS, CONTAINER_KINDS, NOISY_KINDS, TYPE_KINDS


def _one(g: PropertyGraph, node_id: str) -> DataFrame:
    return g.nodes.where(F.col("id") == node_id).select("id")


def bfs(g: PropertyGraph, start: str, depth: int | None = None, limit: int | None = 1000, direction: str = "outgoing", edge_kinds: tuple[str, ...] = (), node_kinds: tuple[str, ...] = (), include_start: bool = True) -> DataFrame:
    """(id, level, parent, kind) of a breadth-first tree from start; empty if there is no such node.

    A node of another kind than node_kinds is neither kept nor passed. A depth or limit
    of 0 or less means none and 1000. Under the limit nodes of lower level come first,
    then by id; without one (None) all are there, in no order.
    """
    depth = depth if depth and depth > 0 else None
    limit = limit if limit is None or limit > 0 else 1000
    allowed = g.nodes.where(F.col("kind").isin(*node_kinds)) if node_kinds else None
    found = tree(oriented(g.steady_edges(edge_kinds), direction), _one(g, start), depth, allowed, None if limit is None else limit + (not include_start))
    if not include_start:
        found = found.where("level > 0")
    return found if limit is None else found.orderBy("level", "id").limit(limit)


def dfs(g: PropertyGraph, start: str, depth: int | None = None, limit: int | None = 1000, direction: str = "outgoing", edge_kinds: tuple[str, ...] = (), node_kinds: tuple[str, ...] = (), include_start: bool = True) -> DataFrame:
    """The same nodes as bfs: a set of nodes has no order of visits, so there is one traversal for both."""
    return bfs(g, start, depth, limit, direction, edge_kinds, node_kinds, include_start)


def callers(g: PropertyGraph, node_id: str, depth: int = 1) -> DataFrame:
    """Edges of call kinds against which node_id is reached within depth: a row for each, with the level at which it is found."""
    return _calls(g, node_id, depth, "incoming")


def callees(g: PropertyGraph, node_id: str, depth: int = 1) -> DataFrame:
    return _calls(g, node_id, depth, "outgoing")


def _calls(g: PropertyGraph, node_id: str, depth: int, direction: str) -> DataFrame:
    near, far = ("target", "source") if direction == "incoming" else ("source", "target")
    if depth == 1:  # a filter and a join, without a loop
        e = g.edges.where(F.col("kind").isin(*CALL_KINDS) & (F.col(near) == node_id))
        return e.join(g.nodes.select(F.col("id").alias(far), "name", "file_path"), far).select(F.col(far).alias("id"), "name", "file_path", "kind", "line", F.lit(1).alias("level"))
    e = g.steady_edges(CALL_KINDS)
    reached = levels(oriented(e, direction), _one(g, node_id), depth - 1)
    hit = e.join(reached.select(F.col("id").alias(near), "level"), near)
    return hit.join(g.nodes.select(F.col("id").alias(far), "name", "file_path"), far).select(F.col(far).alias("id"), "name", "file_path", "kind", "line", (F.col("level") + 1).alias("level"))


def call_graph(g: PropertyGraph, node_id: str, depth: int) -> DataFrame:
    return bfs(g, node_id, depth, 1000, "both", CALL_KINDS)


def impact(g: PropertyGraph, node_id: str, depth: int) -> DataFrame:
    """(id, level) of what a change of node_id may affect within depth.

    Nodes against all edges but containment; of containers found before the last level
    also all that they contain, through containers alone. Those aren't seeds of further
    impact; they have the level of their container.
    """
    uses = g.edges.where("kind != 'contains'")
    hit = levels(oriented(cut(uses.select("source", "target", "kind", "line")), "incoming"), _one(g, node_id), depth)
    containers = g.nodes.where(F.col("kind").isin(*CONTAINER_KINDS)).select("id")
    inside = g.steady_edges(("contains",))
    # a container is opened when it is found before the last level, or in one that is open; again if a nearer one has it
    frontier = opened = cut(hit.where(F.col("level") < depth).join(containers, "id", "left_semi"))
    found = [hit]
    while not frontier.isEmpty():
        below = cut(inside.join(frontier.select(F.col("id").alias("source"), "level"), "source").groupBy(F.col("target").alias("id")).agg(F.min("level").alias("level")))
        found.append(below)
        nearer = below.join(containers, "id", "left_semi").join(opened.select("id", F.col("level").alias("was")), "id", "left").where("was IS NULL OR level < was").select("id", "level")
        frontier = cut(nearer)
        opened = cut(opened.unionByName(frontier).groupBy("id").agg(F.min("level").alias("level")))
    return union_all(found).groupBy("id").agg(F.min("level").alias("level"))


def impact_by_file(g: PropertyGraph, node_id: str, depth: int) -> DataFrame:
    """(file_path, n, level) of impact(): how many nodes of each file, and the least level."""
    hit = g.nodes.select("id", "file_path").join(impact(g, node_id, depth), "id")
    return hit.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("level"))


def type_ancestors(g: PropertyGraph, node_id: str) -> DataFrame:
    return levels(oriented(g.steady_edges(TYPE_KINDS), "outgoing"), _one(g, node_id)).where("level > 0")


def type_descendants(g: PropertyGraph, node_id: str) -> DataFrame:
    return levels(oriented(g.steady_edges(TYPE_KINDS), "incoming"), _one(g, node_id)).where("level > 0")


def type_hierarchy(g: PropertyGraph, node_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes above, beneath and at node_id, and every type edge that goes out of one of them."""
    ids = cut(_one(g, node_id).union(type_ancestors(g, node_id).select("id")).union(type_descendants(g, node_id).select("id")).distinct())
    e = g.steady_edges(TYPE_KINDS)
    return ids, e.join(ids.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", "kind")


def ancestors(g: PropertyGraph, node_id: str) -> DataFrame:
    """(id, level) up the containment chain: of several containers of a node the least by id. A cycle ends the chain."""
    up = first_of(g.steady_edges(("contains",)), ["target"], ["source"]).select(F.col("target").alias("at"), F.col("source").alias("to"))
    return levels(cut(up), _one(g, node_id)).where("level > 0")


def path(g: PropertyGraph, start: str, goal: str) -> list[tuple[str, str]] | None:
    """A shortest way over outgoing edges as steps (node, kind of the edge to it): none of them for start itself, None without a way.

    Of several shortest ways the one that the breadth-first tree has.
    """
    if start == goal:
        return []
    found = tree_levels(oriented(g.steady_edges(), "outgoing"), _one(g, start), goal=goal)
    if found[-1].where(F.col("id") == goal).isEmpty():
        return None
    # one plan walks up: from each level the parent of the one below
    at = found[-1].where(F.col("id") == goal)
    rows = [at]
    for level in found[-2:0:-1]:
        at = level.join(F.broadcast(at.select(F.col("parent").alias("id"))), "id").select(*level.columns)
        rows.append(at)
    return [(r.id, r.kind) for r in union_all(rows).orderBy("level").collect()]


def distance(g: PropertyGraph, start: str, goal: str) -> DataFrame:
    """(hops) of a shortest way over outgoing edges; no row without one."""
    found = levels(oriented(g.steady_edges(), "outgoing"), _one(g, start), goal=goal)
    return found.where(F.col("id") == goal).select(F.col("level").alias("hops"))


def view(g: PropertyGraph, seeds: DataFrame, degree: int = 3, most: int = 250, include_imports: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to draw around seeds (id): undirected, without noisy kinds of edges, the nearest nodes first, then by id; edges among them.

    Nodes have the number of edges drawn at them and a size.
    """
    from tessera.operators.aggregates import degrees, node_size
    from tessera.operators.joins import induced

    e = g.edges if include_imports else g.edges.where(~F.col("kind").isin(*NOISY_KINDS))
    e = cut(e.select("source", "target", "kind", "line"))
    found = levels(oriented(e, "both"), seeds, degree, enough=most).orderBy("level", "id").limit(most)
    n = cut(g.nodes.where(~F.col("kind").isin("import", "export")).join(found, "id").select("id", "kind", "name", "qualified_name", "file_path", "start_line", "level"))
    drawn = induced(e, n).select("source", "target", "kind")
    d = F.coalesce("degree", F.lit(0))
    return n.join(degrees(drawn), "id", "left").withColumn("degree", d).withColumn("size", node_size(F.col("degree"))), drawn


def context(g: PropertyGraph, node_id: str) -> DataFrame:
    """(role, id, edge_kind) of all that belongs to a node: itself, ancestors, children, references in and out."""
    from tessera.operators.joins import children, references

    none = F.lit(None).cast("string")
    return (
        _one(g, node_id).select(F.lit("focal").alias("role"), "id", none.alias("edge_kind"))
        .unionByName(ancestors(g, node_id).select(F.lit("ancestor").alias("role"), "id", none.alias("edge_kind")))
        .unionByName(children(g.nodes, g.edges, node_id).select(F.lit("child").alias("role"), "id", none.alias("edge_kind")))
        .unionByName(references(g.nodes, g.edges, node_id, "incoming").select(F.lit("incoming").alias("role"), "id", "edge_kind"))
        .unionByName(references(g.nodes, g.edges, node_id, "outgoing").select(F.lit("outgoing").alias("role"), "id", "edge_kind"))
    )


def glue(g: PropertyGraph, roots: DataFrame, members: DataFrame, cap: int = 60) -> DataFrame:
    """Callers and callees of roots (id) that aren't members (id) but stand in a file of one; the first cap by id."""
    e = g.edges.where(F.col("kind").isin(*CALL_KINDS))
    r = roots.select("id")
    near = e.join(r.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id")).union(e.join(r.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))).distinct()
    out = in_same_files(g.nodes.join(near, "id", "left_semi").join(members.select("id"), "id", "left_anti"), members, g.nodes)
    return out.orderBy("id").limit(cap)
