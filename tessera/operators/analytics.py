"""Analytics over the whole graph: file cycles, random walks with restart, path proximity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import directory_of
from tessera.operators import walk
from tessera.plans.fixpoint import levels
from tessera.plans.lineage import cut
from tessera.plans.schema import RANK_KINDS

#: The chance of a restart, and the number of rounds.
RESTART, ROUNDS = 0.25, 25
# Points of a candidate's nearness to a reference, and the leading directories that count at most.
SAME_FILE, SAME_DIRECTORY, STEP, LEADING, EXPORTED = 100, 30, 10, 8, 10
#: Layers that are peeled in one job, and the share of edges that must go for another such job; what isn't peeled is found not to be on a cycle all the same.
PEELED, PEELING_PAYS = 2, 0.999


def cyclic_files(dependencies: DataFrame) -> DataFrame:
    """(file) of every file on a cycle of dependencies (from_file, to_file), with its cycle's least file.

    Files with no way in or out are peeled off while that takes off much. What is left is coloured
    with the least file that reaches each; the files that a colour's file reaches back
    from within its colour are one strongly connected part and leave, until none is left.
    """
    e = cut(dependencies.where("from_file != to_file").select(F.col("from_file").alias("s"), F.col("to_file").alias("t")).distinct())
    done: DataFrame | None = None
    while True:
        size = e.count()
        while size:  # peel layers, several at a time, as long as that takes off much
            for _ in range(PEELED):
                e = e.join(e.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(e.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t")
            e = cut(e)
            left = e.count()
            if left > PEELING_PAYS * size or not left:
                break
            size = left
        left = e.count()
        if not left:
            break
        colour = cut(e.select(F.col("s").alias("v")).union(e.select("t")).distinct().withColumn("c", F.col("v")))
        while True:
            near = e.join(colour.select(F.col("v").alias("s"), "c"), "s").groupBy(F.col("t").alias("v")).agg(F.min("c").alias("n"))
            new = cut(colour.join(near, "v", "left").select("v", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved")))
            colour = new.select("v", "c")
            if new.where("moved").isEmpty():
                break
        inner = e.join(colour.select(F.col("v").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("v").alias("t"), F.col("c").alias("ct")), "t").where("cs = ct")
        back = cut(inner.select(F.struct("t", "ct").alias("at"), F.struct(F.col("s").alias("t"), F.col("cs").alias("ct")).alias("to")))
        roots = colour.where("v = c").select(F.struct(F.col("v").alias("t"), F.col("c").alias("ct")).alias("id"))
        part = cut(levels(back, roots).select(F.col("id.t").alias("file"), F.col("id.ct").alias("cycle")))
        whole = part.join(part.groupBy("cycle").count().where("count > 1").select("cycle"), "cycle", "left_semi").select("file", "cycle")
        done = whole if done is None else done.unionByName(whole)
        gone = part.select("file")
        e = cut(e.join(gone.withColumnRenamed("file", "s"), "s", "left_anti").join(gone.withColumnRenamed("file", "t"), "t", "left_anti").select("s", "t"))
        if e.isEmpty():
            break
    return done if done is not None else e.select(F.col("s").alias("file"), F.col("t").alias("cycle")).limit(0)


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): how many containers stand above each node; null where the chain of them never ends.

    Of several containers the least by id counts. Chains are halved in each round, by
    what a node's farthest known container knows, so rounds grow with the logarithm of
    the depth.
    """
    up = edges.where("kind = 'contains'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("top"))
    known = cut(nodes.select("id").join(up, "id", "left").select("id", "top", F.when(F.col("top").isNull(), 0).otherwise(1).alias("depth")))
    # containers that aren't nodes end a chain, too
    open_, before = known.where("top IS NOT NULL").count(), -1
    while open_ and open_ != before:
        far = known.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        known = cut(known.join(far, "top", "left").select("id", F.col("next").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        before, open_ = open_, known.where("top IS NOT NULL").count()
    return known.select("id", F.when(F.col("top").isNull(), F.col("depth")).alias("depth"))


def random_walk(edges: DataFrame, ids: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, restart: float = RESTART) -> DataFrame:
    """(id, score) of a random walk with restart over the nodes ids (id), by exactly so many rounds.

    The graph is undirected, edges of ranking kinds count as often as they stand there,
    loops don't count, and a node without neighbours keeps its share. Restarts are
    uniform over the seeds that are there, or over all nodes if none is.
    Graphs of up to PACKED_NODES nodes are packed, and rounds exchange scores alone; larger
    ones exchange their steps in each round.
    """
    e = edges.where(F.col("kind").isin(*RANK_KINDS)).select("source", "target")
    rows = ids.count()
    if rows <= walk.PACKED_NODES:
        return walk.packed_walk(e, ids, seeds, rounds, restart, rows)
    return _walk_by_joins(e, ids, seeds, rounds, restart)


def _walk_by_joins(edges: DataFrame, ids: DataFrame, seeds: DataFrame, rounds: int, restart: float) -> DataFrame:
    """The same by joins of weighted steps with scores, for any number of nodes."""
    n = cut(ids.select("id").distinct())
    e = edges.where("source != target")
    e = e.join(n.withColumnRenamed("id", "source"), "source", "left_semi").join(n.withColumnRenamed("id", "target"), "target", "left_semi")
    both = e.select(F.col("source").alias("at"), F.col("target").alias("to")).union(e.select("target", "source"))
    weights = both.groupBy("at", "to").agg(F.count(F.lit(1)).alias("w"))
    steps = cut(weights.join(weights.groupBy("at").agg(F.sum("w").alias("d")), "at").select("at", "to", (F.col("w") / F.col("d")).alias("p")))
    there = n.join(seeds.select("id").distinct(), "id", "left_semi").withColumn("is_seed", F.lit(1.0))
    count, total = there.count(), n.count()
    r = (F.coalesce("is_seed", F.lit(0.0)) / count) if count else F.lit(1.0 / max(total, 1))
    lone = n.join(steps.select(F.col("at").alias("id")).distinct(), "id", "left_anti").withColumn("lone", F.lit(True))
    s = cut(n.join(there, "id", "left").join(lone, "id", "left").select("id", r.alias("r"), F.coalesce("lone", F.lit(False)).alias("lone"), r.alias("s")))
    for k in range(rounds):
        moved = steps.join(s.select(F.col("id").alias("at"), "s"), "at").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("p") * F.col("s")).alias("m"))
        s = s.join(moved, "id", "left").select("id", "r", "lone", ((1 - restart) * F.when(F.col("lone"), F.col("s")).otherwise(F.coalesce("m", F.lit(0.0))) + restart * F.col("r")).alias("s"))
        if k % 4 == 3:
            s = cut(s)
    return s.select("id", F.col("s").alias("score"))


def random_walk_small(ids: list[str], edges: list[tuple[str, str]], seeds: list[str], rounds: int = ROUNDS, restart: float = RESTART) -> dict[str, float]:
    """The same for a subgraph of a few hundred nodes that is on the driver already."""
    at = {x: i for i, x in enumerate(dict.fromkeys(ids))}
    m = np.zeros((len(at), len(at)))
    for a, b in edges:
        if a in at and b in at and a != b:
            m[at[b], at[a]] += 1
            m[at[a], at[b]] += 1
    d = m.sum(0)
    m[:, d > 0] /= d[d > 0]
    m[np.diag_indices(len(at))] += d == 0
    there = [at[s] for s in dict.fromkeys(seeds) if s in at]
    r = np.zeros(len(at))
    r[there or slice(None)] = 1 / (len(there) or max(len(at), 1))
    s = r.copy()
    for _ in range(rounds):
        s = (1 - restart) * m @ s + restart * r
    return {x: float(s[i]) for x, i in at.items()}


def proximity(ref_path: Column, path: Column, exported: Column) -> Column:
    """How near a candidate's file is to a reference's: the same file, the same directory, shared leading directories, and whether it is exported."""
    a, b = directory_of(ref_path), directory_of(path)
    pa, pb = F.split(a, "/"), F.split(b, "/")
    pairs = F.zip_with(pa, pb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, same: F.struct((acc["n"] + F.when(acc["on"] & same, 1).otherwise(0)).alias("n"), (acc["on"] & same).alias("on")), lambda acc: acc["n"])
    shared = F.when((a == "") | (b == ""), 0).otherwise(shared)
    return F.when(ref_path == path, SAME_FILE).otherwise(0) + F.when(a == b, SAME_DIRECTORY).otherwise(0) + F.least(STEP * shared, F.lit(STEP * LEADING)) + F.when(exported, EXPORTED).otherwise(0)
